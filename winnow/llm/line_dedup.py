"""Line dedup with a log-template tree.

A line is split into tokens at white space. The tree has a fixed depth: its first level is the number of tokens, the next ones the
leading tokens, with tokens that hold a digit read as the variable field <*>. A leaf's lines are
generalised to one template: a position keeps its token if more than half of the leaf's lines have it there, else it becomes <*>;
the template holds if at least half of its positions are literal, and a line is an instance if it agrees in all
of them. A line whose digits alone vary is an instance of its own masked form in any case.

A template whose instances lie in ``min_docs`` documents or more recurs. Its lines are dropped from all documents
except the first (the smallest doc_id), so that no passage vanishes from the corpus. With ``strict`` (the pipeline) a template also needs literals at
half of the positions behind the leading tokens, a masked form needs a literal, and of every distinct line that only a general template drops,
one copy stays; and a whole line, also of one or two tokens, recurs from a number of documents on that falls with its length (needed_docs). Without it
(the query, as its SQL says) none of this holds. Lines with fewer than
``min_tokens`` tokens always stay. Documents stay even if all their lines go; their text is then empty.

Null texts stay null; an empty text is one empty line and stays. Very long lines and texts are lines and texts like others. Rows with a null doc_id count as documents and are never
the first. Rows that repeat doc_id and text are one document. An empty table gives an empty result. Columns of docs may have any names; those named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm import store


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def masked_line(line: Column, *, both: bool = False) -> Column:
    """Tokens with one blank between them, those with a digit as <*>; if both, a struct of that without and with <*>. Regular expressions replace only where there is something to replace."""
    untidy = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | F.rlike(line, F.lit(r"[\x09-\x0D]"))
    plain = F.when(untidy, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)
    masked = F.when(F.rlike(line, F.lit("[0-9]")), F.regexp_replace(plain, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(plain)
    return F.struct(plain.alias("plain"), masked.alias("masked")) if both else masked


def parsed_lines(docs: DataFrame, id_col: str, text_col: str, depth: int, min_tokens: int, strict: bool = False) -> DataFrame:
    """(row, id, pos, masked, n, leaf, exact, raw): one row for each line of min_tokens tokens or more."""
    # inside transform() a line is parsed once; as a projection it would be parsed again for the filter on n
    masked = F.transform(F.split(F.col(f"`{text_col}`"), "\n"), lambda line: masked_line(line, both=strict))
    lines = docs.select(_row_key(id_col, text_col).alias("row"), F.col(f"`{id_col}`").alias("id"), F.posexplode(masked).alias("pos", "masked"))
    if strict:
        lines = lines.withColumn("plain", F.col("masked.plain")).withColumn("masked", F.col("masked.masked"))
    lines = lines.withColumn("n", F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1).where(F.col("n") >= min_tokens)
    leaf = F.xxhash64("n", F.substring_index("masked", " ", depth))
    if not strict:
        return lines.withColumn("leaf", leaf).withColumn("exact", F.xxhash64("masked")).withColumn("raw", F.lit(None).cast("long"))
    literal = F.replace(F.replace("masked", F.lit("<*>"), F.lit("")), F.lit(" "), F.lit("")) != ""
    exact = F.xxhash64(F.when(literal, F.col("masked")).otherwise(F.col("plain")))
    return lines.withColumn("leaf", leaf).withColumn("exact", exact).withColumn("raw", F.xxhash64("plain")).drop("plain")


def recurring(uses: DataFrame, min_docs: int) -> DataFrame:
    """uses (template, row, id) -> (template, first_id) of the templates that lie in min_docs rows or more."""
    once = uses.groupBy("template", "row").agg(F.min("id").alias("id"))
    return once.groupBy("template").agg(F.count("*").alias("docs"), F.min("id").alias("first_id")).where(F.col("docs") >= min_docs).select("template", "first_id")


def needed_docs(n: Column, min_docs: int) -> Column:
    """In how many documents a line of n tokens must stand to recur: min_docs, less for long ones, more for one or two tokens."""
    return F.when(n >= 50, 2).when(n >= 20, 3).when(n >= 10, (min_docs + 1) // 2).when(n >= 3, min_docs).otherwise(3 * min_docs)


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, depth: int = 3, min_docs: int = 10, min_tokens: int = 3, strict: bool = False) -> DataFrame:
    """docs with the recurring lines gone from the text, and the columns n_lines and n_dropped.

    depth: leading tokens on a path of the tree.
    """
    lines = parsed_lines(docs, id_col, text_col, depth, 1 if strict else min_tokens, strict)
    if strict:
        lines = lines.where("masked <> ''")
    marks = store.saved(lines.select("row", "id", "pos", "leaf", "exact", "n"), "lines")

    # leaves in enough documents, then their templates
    leaves = recurring(marks.where(F.col("n") > (depth if strict else 0)).select(F.col("leaf").alias("template"), "row", "id"), min_docs).select(F.col("template").alias("leaf"))
    leaves = store.small(store.saved(leaves, "leaves"))
    inside = store.saved(lines.join(leaves, "leaf", "left_semi").select("row", "id", "pos", "leaf", "raw", F.split("masked", " ").alias("tokens")), "inside")
    counts = inside.select("leaf", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count("*").alias("times"))
    most = counts.groupBy("leaf", "at").agg(F.sum("times").alias("all"), F.max(F.struct("times", "token")).alias("top"))
    most = most.withColumn("literal", F.expr("2 * top.times > all and top.token <> '<*>'"))
    spec = most.groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.when(F.col("literal"), F.struct("at", "top.token")))).alias("literals"), F.count("*").alias("width"), F.count_if("literal").alias("fixed"), F.count_if(F.col("literal") & (F.col("at") >= depth)).alias("behind"))
    if strict:
        spec = spec.where(f"behind > 0 AND 2 * behind >= width - {depth}")
    spec = spec.where("2 * fixed >= width").select("leaf", "literals")
    spec = store.small(store.saved(spec, "templates"))
    fits = F.expr("forall(map_entries(literals), e -> tokens[e.key] = e.value)")
    general = general_table = store.saved(inside.join(spec, "leaf").where(fits).select(F.col("leaf").alias("template"), "row", "id", "pos", "raw"), "general")
    firsts = recurring(general, min_docs)
    if strict:  # the first copy of each distinct line instead of the template's first document
        line = F.xxhash64("template", "raw").alias("template")
        firsts = general.join(firsts.select("template"), "template", "left_semi").groupBy(line).agg(F.min("id").alias("first_id"))
        general = general.select(line, "row", "id", "pos", "raw")
    general = general.drop("raw")

    exact = marks.select(F.col("exact").alias("template"), "row", "id", "pos")
    repeats = recurring(exact, min_docs)
    if strict:
        once = marks.groupBy(F.col("exact").alias("template"), "row").agg(F.min("id").alias("id"), F.min("n").alias("n"))
        repeats = once.groupBy("template").agg(F.count("*").alias("docs"), F.min("id").alias("first_id"), F.min("n").alias("n"))
        repeats = repeats.where(F.col("docs") >= needed_docs(F.col("n"), min_docs)).select("template", "first_id")
    uses = general.withColumn("kind", F.lit(1)).unionByName(exact.withColumn("kind", F.lit(0)))
    again = firsts.withColumn("kind", F.lit(1)).unionByName(repeats.withColumn("kind", F.lit(0)))
    again = store.small(store.saved(again, "again"))
    gone = store.saved(uses.join(again, ["kind", "template"]).where("NOT (id <=> first_id)").groupBy("row").agg(F.collect_set("pos").alias("gone")), "gone")
    for table in (general_table, again):
        store.forget(table)

    for table in (marks, leaves, inside, spec):
        store.forget(table)
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.col(f"`{text_col}`")
    numbered = docs.select(_row_key(id_col, text_col).alias("row"), text.alias("text"), *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own) if c != text_col])
    parts = F.split("text", "\n")
    stay = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(F.col("gone"), i)), "\n"))
    out = [stay.alias(c) if c == text_col else F.col(f"own_{i}").alias(c) for i, c in enumerate(own)]
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    n_dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    # a shuffle at every size: how much is moved must not jump where gone outgrows a broadcast
    return numbered.join(gone.hint("merge"), "row", "left").select(*out, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_recurring_lines(docs).select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


#: md5 of the leaf and template stands for the 64-bit hashes of the Spark form.
ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, text, pos, regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked FROM l),
t AS (SELECT *, string_split(masked, ' ') AS tokens FROM m WHERE len(string_split(masked, ' ')) >= 3),
k AS (SELECT *, len(tokens) || ' ' || array_to_string(tokens[1:3], ' ') AS leaf FROM t),
big AS (SELECT leaf FROM k GROUP BY leaf HAVING count(DISTINCT (doc_id, text)) >= 10),
i AS (SELECT * FROM k WHERE leaf IN (SELECT leaf FROM big)),
c AS (SELECT leaf, a, token, count(*) AS times FROM (SELECT leaf, unnest(tokens) AS token, unnest(range(len(tokens))) AS a FROM i) GROUP BY ALL),
top AS (SELECT leaf, a, sum(times) AS n, max(times) AS best, arg_max(token, times) AS token FROM c GROUP BY leaf, a),
lit AS (SELECT *, 2 * best > n AND token <> '<*>' AS f FROM top),
ok AS (SELECT leaf FROM lit GROUP BY leaf HAVING 2 * count(*) FILTER (f) >= count(*)),
miss AS (SELECT DISTINCT i.doc_id, i.text, i.pos FROM i JOIN lit ON i.leaf = lit.leaf AND lit.f AND i.tokens[lit.a + 1] <> lit.token),
g AS (SELECT i.doc_id, i.text, i.pos, i.leaf AS template FROM i JOIN ok USING (leaf) ANTI JOIN miss ON i.doc_id = miss.doc_id AND i.text = miss.text AND i.pos = miss.pos),
u AS (SELECT 1 AS kind, doc_id, text, pos, template FROM g UNION ALL SELECT 0, doc_id, text, pos, masked FROM k),
again AS (SELECT kind, template, min(doc_id) AS first_id FROM u GROUP BY ALL HAVING count(DISTINCT (doc_id, text)) >= 10),
gone AS (SELECT DISTINCT u.doc_id, u.text, u.pos FROM u JOIN again USING (kind, template) WHERE u.doc_id IS DISTINCT FROM first_id),
kept AS (SELECT l.doc_id, l.text, count(*) AS n, count(gone.pos) AS dropped, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (gone.pos IS NULL), '') AS rest
         FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.text = gone.text AND l.pos = gone.pos GROUP BY l.doc_id, l.text)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(dropped, 0) AS BIGINT) AS n_dropped, md5(coalesce(rest, '')) AS text_md5
FROM documents d LEFT JOIN kept k2 ON d.doc_id = k2.doc_id AND d.text = k2.text
"""
