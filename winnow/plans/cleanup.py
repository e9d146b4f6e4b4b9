"""One scan, and the cleanup planned from it step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.operators import groups as g
from winnow.operators import ledger, plan
from winnow.sources import inventory as inv
from winnow.sources import shared


class Cleanup:
    """A scan of an inventory (scan_tree(), from_table()) with its duplicate groups, and the set of what has been planned away since.

    The filters and ``deep`` are those of a scan: deep groups share their content too, and are verified in full from the start. Groups, their members and the set of removed paths are saved tables, so
    each step reads what the steps before have left. A new Cleanup starts with nothing removed, unless it is given a ledger. forget() deletes its tables.
    """

    def __init__(self, inventory: DataFrame, *, deep: bool = False, skip_hidden: bool = False, media_only: bool = False, removed: DataFrame | None = None):
        self.deep, self.inventory = deep, inventory
        left, counts = inv.observed(inventory, skip_hidden=skip_hidden, media_only=media_only)
        found = shared.saved(g.quick_groups(left), "groups")
        #: total entries, entries left by the filters, and their ratio, counted while the groups were made
        self.summary = inv.summary(counts)
        entries = inv.scan_filters(inventory, skip_hidden=skip_hidden, media_only=media_only)
        if deep or "content" in inventory.columns:
            members = g.with_digest(entries)
        else:
            members = shared.saved(g.members_of(entries, found), "members")
        if deep:
            shared.forget(found)
            found = shared.saved(g.digest_groups(members), "groups")
            digested, members = members, shared.saved(g.members_of(members, found), "members")
            shared.forget(digested)
        self.groups, self.members = found, members
        start = members.select("full_path", "size_bytes").limit(0) if removed is None else removed.select("full_path", "size_bytes")
        self.removed = shared.saved(start, "removed")

    def totals(self) -> DataFrame:
        """One row: groups, members, potential_savings, as found by the scan."""
        return g.totals(self.groups)

    def remaining(self) -> DataFrame:
        """The groups with remaining copies and whether the last one is locked."""
        return g.with_remaining(self.groups, self.members, self.removed)

    def ranked(self, by: str = "name", descending: bool = False) -> DataFrame:
        return g.ranked(self.remaining(), by, descending)

    def any_removable(self) -> bool:
        return g.any_removable(self.remaining()).first()[0]

    def remove(self, requests: DataFrame) -> DataFrame:
        """Decides requests (full_path, seq) in the order of seq; those granted are removed from now on. (seq, full_path, name, size_bytes, outcome)."""
        return self._done(plan.request_plan_ordered(self.members, requests, self.removed, self.deep))

    def remove_all(self) -> DataFrame:
        """The batch: in each group all that equal its first copy left are removed from now on. (full_path, name, size_bytes, reference_path, action)."""
        return self._done(plan.batch_plan(self.members, self.removed, self.deep))

    def _done(self, decided: DataFrame) -> DataFrame:
        made = shared.saved(decided, "plan")
        before, self.removed = self.removed, shared.saved(ledger.add(self.removed, plan.removals(made)), "removed")
        shared.forget(before)
        return made

    def recovered(self) -> DataFrame:
        """One row: removed paths and their bytes."""
        return ledger.recovered(self.removed)

    def survivors(self) -> DataFrame:
        """The inventory without what was removed."""
        return plan.survivors(self.inventory, self.removed)

    def files(self, most: int = 10_000) -> DataFrame:
        """The groups with the paths that are left of each, in pages."""
        left = g.active(self.members, self.removed)
        return g.with_files(self.groups, left, most).withColumn("left", F.size("files"))

    def forget(self) -> None:
        for table in (self.groups, self.members, self.removed):
            shared.forget(table)
