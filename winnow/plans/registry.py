"""The registered queries of the duplicate-detection operators and their DuckDB counterparts.

The driver's tables are read as inventories: documents (many equal names and sizes, some equal contents), part (hidden names and
extensions) and lineitem (a large quick grouping).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import scalars
from winnow.operators import groups as g
from winnow.operators import ledger, plan
from winnow.sources import inventory as inv
from winnow.sources.listing import listing

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # padded, so that the order of paths is that of the ids
    parent = F.concat(F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 19, "0"), F.lit("/"), F.col("source"))
    return inv.from_table(docs, parent=parent, name=F.concat("lang", F.lit(".txt")), size=F.octet_length("text"), content=F.col("text"))


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    endings = F.array(*[F.lit(e) for e in (".JPG", ".txt", ".mov", ".heic", ".dat", ".PNG", "")])
    hidden = F.when(F.col("p_partkey") % 5 == 0, ".").otherwise("")
    name = F.concat(hidden, F.replace("p_name", F.lit(" "), F.lit("_")), F.element_at(endings, (F.col("p_partkey") % 7 + 1).cast("int")))
    parent = F.concat(F.lit("/parts/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"))
    return inv.from_table(part, parent=parent, name=name, size=F.col("p_size").cast("long") * 1024)


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = F.concat("l_returnflag", "l_linestatus", F.lit("_"), F.date_format("l_shipdate", "yyyyMMdd"), F.lit(".dat"))
    parent = F.concat(F.lit("/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    return inv.from_table(items, parent=parent, name=name, size=F.col("l_quantity").cast("long") * 1024)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.concat(F.lit("/"), F.col("page_id").cast("string"), F.lit("/"), scalars.path_name(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", "")))
    return inv.from_table(pages, parent=scalars.path_parent(path), name=scalars.path_name(path), size=F.octet_length("html"))


def _removed(documents: DataFrame) -> DataFrame:
    """Every seventh document, as removed paths."""
    number = F.element_at(F.split("parent", "/"), 2).cast("long")
    return documents.where(number % 7 == 0).select("full_path", "size_bytes")


def _members(documents: DataFrame) -> DataFrame:
    return g.members_of(documents, g.quick_groups(documents))


_GROUP = ("name", "size_bytes", "copies", "first_path")


def inventory_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _pages(spark, sf_dir).unionByName(_part(spark, sf_dir))
    return both.select("parent", "name", "full_path", "ext", "is_hidden", scalars.kind_label(F.col("is_dir")).alias("kind"), "size_bytes")


def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir).select("full_path", "size_bytes")
    docs = _documents(spark, sf_dir).select("full_path", "size_bytes")
    size = F.col("size_bytes")
    sums = g.quick_groups(_lineitem(spark, sf_dir)).select(F.col("name").alias("full_path"), (size * size * F.col("copies")).alias("size_bytes")).distinct()
    rows = part.unionByName(docs).unionByName(sums)
    return rows.select("full_path", "size_bytes", scalars.file_size_label(size).alias("file_label"), scalars.total_size_label(size).alias("total_label"))


def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = {"none": {}, "hidden": {"skip_hidden": True}, "media": {"media_only": True}, "both": {"skip_hidden": True, "media_only": True}}
    return inv.scan_summaries(_part(spark, sf_dir), filters)


def _filtered(**how: bool) -> Query:
    return lambda spark, sf_dir: g.quick_groups(inv.scan_filters(_part(spark, sf_dir), **how)).select(*_GROUP)


def quick_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.quick_groups(_documents(spark, sf_dir)).select(*_GROUP)


def quick_groups_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.quick_groups(_lineitem(spark, sf_dir)).select("name", "size_bytes", "copies")


def group_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deep groups with the paths of their members, at most about a thousand in a row."""
    members = _digested(spark, sf_dir)
    out = g.with_files(g.digest_groups(members), members, 1000).withColumn("n_files", F.size("files").cast("long"))
    first, last = F.element_at("files", 1), F.element_at("files", -1)
    lines = F.sum(F.length(F.array_join("files", "\n"))).cast("long")
    return out.groupBy("name", "size_bytes", "sha256", "copies").agg(F.sum("n_files").alias("files"), F.min(first).alias("first_file"), F.max(last).alias("last_file"), (lines + F.count("*") - 1).alias("listing_chars"))


def deep_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.deep_groups(_documents(spark, sf_dir)).select("name", "size_bytes", "sha256", "copies", "first_path")


def quick_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.totals(g.quick_groups(_documents(spark, sf_dir)))


def deep_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.totals(g.deep_groups(_documents(spark, sf_dir)))


def _with_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return g.with_remaining(g.quick_groups(docs), docs, _removed(docs))


def _rank(by: str, descending: bool) -> Query:
    return lambda spark, sf_dir: g.ranked(_with_remaining(spark, sf_dir), by, descending).select("rank", "name", "size_bytes", "remaining")


def remaining_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_remaining(spark, sf_dir).select("name", "size_bytes", "copies", "remaining", "locked")


def any_removable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.any_removable(_with_remaining(spark, sf_dir))


def _digested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of quick groups with their digests, made once and saved for all that reads them."""
    return g.with_digest(_documents(spark, sf_dir))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.batch_plan(_digested(spark, sf_dir))


def deep_batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _digested(spark, sf_dir)
    return plan.batch_plan(g.members_of(members, g.digest_groups(members)), deep=True)


def deep_request_plan_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for every member of every deep group, highest document first, after every seventh document went."""
    digested = _digested(spark, sf_dir)
    members = g.members_of(digested, g.digest_groups(digested))
    requests = members.select("full_path", (-F.element_at(F.split("parent", "/"), 2).cast("long")).alias("seq"))
    return plan.request_plan_ordered(members, requests, _removed(_documents(spark, sf_dir)), deep=True)


def batch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.batch_outcome(_plan(spark, sf_dir))


def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.survivors(_documents(spark, sf_dir), plan.removals(_plan(spark, sf_dir))).select("full_path", "size_bytes")


def lost_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups the batch plan leaves without a copy: none."""
    docs = _documents(spark, sf_dir)
    return plan.lost_groups(_members(docs), plan.removals(_plan(spark, sf_dir))).agg(F.count("*").alias("lost"))


def request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each quick group (its last member) and one for a path of no group, after every seventh document went."""
    members = _digested(spark, sf_dir)
    asked = members.groupBy("name", "size_bytes").agg(F.max("full_path").alias("full_path")).select("full_path")
    singles = _documents(spark, sf_dir).join(members.select("full_path"), "full_path", "left_anti").agg(F.max("full_path").alias("full_path"))
    out = plan.request_plan(members, asked.unionByName(singles), _removed(_documents(spark, sf_dir)))
    return out.fillna("", ["name", "reference_path"]).fillna(0, ["size_bytes"])


def request_plan_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for every member of every quick group, highest document first."""
    members = _digested(spark, sf_dir)
    requests = members.select("full_path", (-F.element_at(F.split("parent", "/"), 2).cast("long")).alias("seq"))
    return plan.request_plan_ordered(members, requests)


def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each quick group seems to waste, beside what a batch that compares contents frees of it, and what its deep groups waste."""
    return plan.savings(_digested(spark, sf_dir))


def recovered_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return ledger.recovered(ledger.add(_removed(docs), plan.removals(_plan(spark, sf_dir))))


def export_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(_part(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "inventory_columns": inventory_columns,
    "size_labels": size_labels,
    "scan_summary": scan_summary,
    "filter_hidden": _filtered(skip_hidden=True),
    "filter_media": _filtered(media_only=True),
    "filter_both": _filtered(skip_hidden=True, media_only=True),
    "quick_groups": quick_groups,
    "quick_groups_large": quick_groups_large,
    "deep_groups": deep_groups,
    "group_files": group_files,
    "quick_totals": quick_totals,
    "deep_totals": deep_totals,
    "rank_by_name": _rank("name", False),
    "rank_by_size": _rank("size", True),
    "rank_by_copies": _rank("copies", True),
    "remaining_copies": remaining_copies,
    "any_removable": any_removable,
    "batch_plan": _plan,
    "deep_batch_plan": deep_batch_plan,
    "deep_request_plan_ordered": deep_request_plan_ordered,
    "batch_outcome": batch_outcome,
    "survivors": survivors,
    "lost_groups": lost_groups,
    "request_plan": request_plan,
    "request_plan_ordered": request_plan_ordered,
    "savings": savings,
    "recovered_total": recovered_total,
    "export_listing": export_listing,
}

_DOCS = """docs AS (SELECT doc_id, '/' || lpad(CAST(doc_id AS VARCHAR), 19, '0') || '/' || source || '/' || lang || '.txt' AS full_path,
  lang || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size_bytes, text AS content FROM documents)"""
_PART = """part_inv AS (SELECT '/parts/' || p_brand || '/' || p_partkey AS parent, CASE WHEN p_partkey % 5 = 0 THEN '.' ELSE '' END || replace(p_name, ' ', '_')
  || (['.JPG', '.txt', '.mov', '.heic', '.dat', '.PNG', ''])[CAST(p_partkey % 7 AS INT) + 1] AS name, CAST(p_size AS BIGINT) * 1024 AS size_bytes FROM part),
  p AS (SELECT *, parent || '/' || name AS full_path, lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) AS ext, name LIKE '.%' AS is_hidden FROM part_inv)"""
_MEDIA = "ext IN (" + ", ".join(f"'{e}'" for e in scalars.MEDIA_EXTENSIONS) + ")"
_QUICK = "SELECT name, size_bytes, count(*) AS copies, min(full_path) AS first_path FROM {} GROUP BY name, size_bytes HAVING count(*) > 1"
_LINES = """items AS (SELECT l_returnflag || l_linestatus || '_' || strftime(l_shipdate, '%Y%m%d') || '.dat' AS name, CAST(l_quantity AS BIGINT) * 1024 AS size_bytes FROM lineitem)"""
_DEEP = """deep AS (SELECT name, size_bytes, sha256(content) AS sha256, count(*) AS copies, min(full_path) AS first_path FROM docs GROUP BY ALL HAVING count(*) > 1)"""
_TOTALS = "SELECT count(*) AS groups, CAST(coalesce(sum(copies), 0) AS BIGINT) AS members, CAST(coalesce(sum(size_bytes * (copies - 1)), 0) AS BIGINT) AS potential_savings FROM {}"
_LEFT = f"""{_DOCS}, quick AS ({_QUICK.format("docs")}),
  remaining AS (SELECT q.*, CAST(count(d.doc_id) FILTER (d.doc_id % 7 <> 0) AS BIGINT) AS remaining FROM quick q JOIN docs d USING (name, size_bytes) GROUP BY ALL)"""
_PLAN = f"""{_DOCS}, ranked AS (SELECT *, count(*) OVER w AS n, min(full_path) OVER w AS reference_path FROM docs WINDOW w AS (PARTITION BY name, size_bytes)),
  plan AS (SELECT r.full_path, r.name, r.size_bytes, r.reference_path,
    CASE WHEN r.full_path = r.reference_path THEN 'keep' WHEN coalesce(r.content = f.content, false) THEN 'remove' ELSE 'skip' END AS action
    FROM ranked r JOIN docs f ON f.full_path = r.reference_path WHERE r.n > 1)"""
_LABEL = """CASE WHEN size_bytes / 1024.0 < 1024 THEN printf('%.2f KB', CAST(size_bytes AS DOUBLE) / 1024) ELSE printf('%.2f MB', CAST(size_bytes AS DOUBLE) / 1048576) END"""
_TOTAL = """CASE WHEN size_bytes >= 1099511627776 THEN printf('%.2f TB', CAST(size_bytes AS DOUBLE) / 1099511627776) WHEN size_bytes >= 1073741824 THEN printf('%.2f GB', CAST(size_bytes AS DOUBLE) / 1073741824)
  WHEN size_bytes >= 1048576 THEN printf('%.2f MB', CAST(size_bytes AS DOUBLE) / 1048576) ELSE printf('%.2f KB', CAST(size_bytes AS DOUBLE) / 1024) END"""


def _summary(name: str, condition: str) -> str:
    return f"SELECT '{name}' AS filter, count(*) AS total, count(*) FILTER ({condition}) AS processed, count(*) FILTER ({condition}) / greatest(1, count(*)) AS ratio FROM p"


def _ranked(order: str) -> str:
    return f"WITH {_LEFT} SELECT row_number() OVER (ORDER BY {order}, name, size_bytes, first_path) AS rank, name, size_bytes, remaining FROM remaining"


ORACLE_SQL: dict[str, str] = {
    "inventory_columns": f"""WITH {_PART}, w AS (SELECT '/' || page_id AS parent, regexp_extract(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '[^/]+$') AS name, CAST(strlen(html) AS BIGINT) AS size_bytes FROM pages)
      SELECT parent, name, full_path, ext, is_hidden, 'File' AS kind, size_bytes FROM p UNION ALL
      SELECT parent, name, parent || '/' || name, lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)), name LIKE '.%', 'File', size_bytes FROM w""",
    "size_labels": f"""WITH {_PART}, {_DOCS}, {_LINES}, sums AS (SELECT name AS full_path, size_bytes * size_bytes * count(*) AS size_bytes FROM items GROUP BY name, items.size_bytes HAVING count(*) > 1),
      s AS (SELECT full_path, size_bytes FROM p UNION ALL SELECT full_path, size_bytes FROM docs UNION ALL SELECT DISTINCT full_path, CAST(size_bytes AS BIGINT) FROM sums)
      SELECT full_path, size_bytes, {_LABEL} AS file_label, {_TOTAL} AS total_label FROM s""",
    "scan_summary": f"WITH {_PART} " + " UNION ALL ".join((_summary("none", "true"), _summary("hidden", "NOT is_hidden"), _summary("media", _MEDIA), _summary("both", f"NOT is_hidden AND {_MEDIA}"))),
    "filter_hidden": f"WITH {_PART} " + _QUICK.format("p WHERE NOT is_hidden"),
    "filter_media": f"WITH {_PART} " + _QUICK.format(f"p WHERE {_MEDIA}"),
    "filter_both": f"WITH {_PART} " + _QUICK.format(f"p WHERE NOT is_hidden AND {_MEDIA}"),
    "quick_groups": f"WITH {_DOCS} " + _QUICK.format("docs"),
    "quick_groups_large": f"WITH {_LINES} SELECT name, size_bytes, count(*) AS copies FROM items GROUP BY name, size_bytes HAVING count(*) > 1",
    "deep_groups": f"WITH {_DOCS}, {_DEEP} SELECT * FROM deep",
    "group_files": f"""WITH {_DOCS} SELECT name, size_bytes, sha256(content) AS sha256, count(*) AS copies, count(*) AS files, min(full_path) AS first_file, max(full_path) AS last_file,
      CAST(length(string_agg(full_path, chr(10))) AS BIGINT) AS listing_chars FROM docs WHERE content IS NOT NULL GROUP BY name, size_bytes, sha256(content) HAVING count(*) > 1""",
    "quick_totals": f"WITH {_DOCS}, quick AS ({_QUICK.format('docs')}) {_TOTALS.format('quick')}",
    "deep_totals": f"WITH {_DOCS}, {_DEEP} {_TOTALS.format('deep')}",
    "rank_by_name": _ranked("name"),
    "rank_by_size": _ranked("size_bytes DESC"),
    "rank_by_copies": _ranked("remaining DESC"),
    "remaining_copies": f"WITH {_LEFT} SELECT name, size_bytes, copies, remaining, remaining <= 1 AS locked FROM remaining",
    "any_removable": f"WITH {_LEFT} SELECT coalesce(bool_or(remaining > 1), false) AS removable FROM remaining",
    "batch_plan": f"WITH {_PLAN} SELECT * FROM plan",
    "deep_batch_plan": f"""WITH {_DOCS}, r AS (SELECT *, count(*) OVER w AS n, min(full_path) OVER w AS reference_path FROM docs WHERE content IS NOT NULL WINDOW w AS (PARTITION BY name, size_bytes, content))
      SELECT full_path, name, size_bytes, reference_path, CASE WHEN full_path = reference_path THEN 'keep' ELSE 'remove' END AS action FROM r WHERE n > 1""",
    # the highest document comes first, so of what is left each but the first goes, and the first is the last copy
    "deep_request_plan_ordered": f"""WITH {_DOCS}, m AS (SELECT *, doc_id % 7 = 0 AS gone, count(*) OVER (PARTITION BY name, size_bytes, content) AS n FROM docs WHERE content IS NOT NULL),
      v AS (SELECT *, min(full_path) FILTER (NOT gone) OVER (PARTITION BY name, size_bytes, content) AS head FROM m WHERE n > 1)
      SELECT -doc_id AS seq, full_path, name, size_bytes, CASE WHEN gone THEN 'already_removed' WHEN full_path = head THEN 'refused_last_copy' ELSE 'removed' END AS outcome FROM v""",
    "batch_outcome": f"""WITH {_PLAN}, n AS (SELECT count(*) FILTER (action = 'remove') AS removed, count(*) FILTER (action = 'skip') AS skipped,
      CAST(coalesce(sum(size_bytes) FILTER (action = 'remove'), 0) AS BIGINT) AS recovered_bytes FROM plan)
      SELECT *, CASE WHEN removed > 0 THEN 'removed' WHEN skipped > 0 THEN 'only_skipped' ELSE 'nothing' END AS outcome FROM n""",
    "survivors": f"WITH {_PLAN} SELECT full_path, size_bytes FROM docs WHERE full_path NOT IN (SELECT full_path FROM plan WHERE action = 'remove')",
    "lost_groups": f"""WITH {_PLAN}, kept AS (SELECT DISTINCT name, size_bytes FROM plan WHERE action <> 'remove')
      SELECT count(*) AS lost FROM (SELECT DISTINCT name, size_bytes FROM plan) p ANTI JOIN kept USING (name, size_bytes)""",
    "request_plan": f"""WITH {_DOCS}, m AS (SELECT *, doc_id % 7 = 0 AS gone FROM docs WHERE (name, size_bytes) IN (SELECT (name, size_bytes) FROM docs GROUP BY name, size_bytes HAVING count(*) > 1)),
      asked AS (SELECT max(full_path) AS full_path FROM m GROUP BY name, size_bytes UNION ALL SELECT max(full_path) FROM docs WHERE full_path NOT IN (SELECT full_path FROM m)),
      t AS (SELECT a.full_path, m.name, m.size_bytes, m.content, m.gone FROM asked a LEFT JOIN m USING (full_path)),
      r AS (SELECT t.full_path, min(o.full_path) AS reference_path, arg_min(o.content, o.full_path) AS ref FROM t JOIN m o ON o.name = t.name AND o.size_bytes = t.size_bytes AND o.full_path <> t.full_path AND NOT o.gone GROUP BY t.full_path)
      SELECT t.full_path, coalesce(t.name, '') AS name, coalesce(t.size_bytes, 0) AS size_bytes, coalesce(r.reference_path, '') AS reference_path, CASE WHEN t.name IS NULL THEN 'not_found' WHEN t.gone THEN 'already_removed' WHEN r.reference_path IS NULL THEN 'refused_last_copy'
        WHEN NOT coalesce(t.content = r.ref, false) THEN 'refused_differs' ELSE 'removed' END AS outcome FROM t LEFT JOIN r ON r.full_path = t.full_path""",
    # the highest document comes first, so each but a group's first member meets that one; the first comes last, when only differing members are left
    "request_plan_ordered": f"""WITH {_DOCS}, m AS (SELECT *, first_value(content) OVER w AS head, min(full_path) OVER w AS head_path, count(*) OVER w AS n FROM docs
        WINDOW w AS (PARTITION BY name, size_bytes ORDER BY full_path ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
      v AS (SELECT *, coalesce(content = head, false) AS same, count(*) FILTER (full_path <> head_path AND NOT coalesce(content = head, false)) OVER (PARTITION BY name, size_bytes) AS differing FROM m WHERE n > 1)
      SELECT -doc_id AS seq, full_path, name, size_bytes, CASE WHEN full_path = head_path THEN CASE WHEN differing > 0 THEN 'refused_differs' ELSE 'refused_last_copy' END
        WHEN same THEN 'removed' ELSE 'refused_differs' END AS outcome FROM v""",
    "savings": f"""WITH {_PLAN}, {_DEEP}, d AS (SELECT name, size_bytes, sum(size_bytes * (copies - 1)) AS deep_savings FROM deep GROUP BY ALL)
      SELECT name, size_bytes, count(*) AS copies, size_bytes * (count(*) - 1) AS potential_savings, CAST(size_bytes * count(*) FILTER (action = 'remove') AS BIGINT) AS verified_savings,
      CAST(coalesce(any_value(deep_savings), 0) AS BIGINT) AS deep_savings FROM plan LEFT JOIN d USING (name, size_bytes) GROUP BY name, size_bytes""",
    "recovered_total": f"""WITH {_PLAN}, l AS (SELECT full_path, size_bytes FROM docs WHERE doc_id % 7 = 0 UNION SELECT full_path, size_bytes FROM plan WHERE action = 'remove')
      SELECT count(*) AS removed, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS recovered_bytes FROM l""",
    "export_listing": f"WITH {_PART} SELECT parent AS path, name, {_LABEL} AS size, 'File' AS type FROM p",
}
