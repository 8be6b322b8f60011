"""One object for a library's folder: scan, compare, explain, review, and the commands on its tables."""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import building, matching, partials, results, review, scope, snapshots
from kindred.plans.settings import ScanSettings, match_settings
from kindred.sources import cache, store

#: What an entry of the fingerprint table holds.
ENTRY = (
    "id long, name string, ext string, size long, mtime long, os_hash string, flags int, is_image boolean, duration double, frames array<array<int>>, ph array<long>, emb array<array<int>>, "
    "emb_valid array<boolean>, folders array<string>, dev string, ino string"
)
#: Columns that are derived from a file's content.
DERIVED = ["duration", "frames", "ph", "emb", "emb_valid"]


class Engine:
    """State lives in the folder (entries, lists, results, settings); methods take and give DataFrames."""

    def __init__(self, spark: SparkSession, folder: str, settings: ScanSettings | None = None):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings or ScanSettings()
        self._log: deque = deque(maxlen=5000)
        self._schema = spark.createDataFrame([], ENTRY).schema

    def log(self, level: str, message: str) -> None:
        self._log.append((time.time(), level, message))

    def logs(self, most: int = 2000) -> list[tuple[float, str, str]]:
        return list(self._log)[-most:]

    def ping(self) -> bool:
        return True

    # Scans

    def entries(self) -> DataFrame:
        return store.load(self.spark, f"{self.folder}/entries", self._schema)

    def scan(self, fingerprints: DataFrame, library: DataFrame, remember_deleted: bool = False) -> DataFrame:
        """Takes new fingerprints (rows like entries) in, marks what the library (id) lacks as deleted, and compares."""
        version = store.save(fingerprints.select(*self._schema.fieldNames()), f"{self.folder}/entries")
        if remember_deleted:
            before = self.entries()
            gone = cache.update_tombstones(before, library.select("id")).join(before.select("id", F.col("flags").alias("_f")), "id").filter("flags <> _f").drop("_f")
            store.save(gone.select(*self._schema.fieldNames()), f"{self.folder}/entries")
        self.log("info", f"entries at version {version}")
        return self.compare()

    def compare(self) -> DataFrame:
        """(group_id, id, difference, flags, is_rep): the groups of what can be compared, without those on the not-a-match list."""
        s = match_settings(self.settings)
        whole = (F.size("frames") == F.when(F.col("is_image"), 1).otherwise(s.positions)) & F.forall("frames", lambda f: f.isNotNull())
        items = self.entries().filter(snapshots.eligible(F.col("frames").isNotNull(), F.col("flags"), whole) & ~cache.has(F.col("flags"), cache.TOMBSTONE))
        items = matching.with_mirrored(items).withColumn("ph_flip", F.col("ph")) if s.flipped and not s.use_phash and not s.combine else matching.with_mirrored(items, hashed=True) if s.flipped else items
        found = building.matched_groups(matching.matches(items, s), items, s).withColumnRenamed("idx", "id")
        ids = found.groupBy("group_id").agg(F.collect_list("id").alias("ids"))
        kept = results.suppress(ids, self._list_rows())
        hidden = ids.join(kept.select("group_id"), "group_id", "left_anti").select("group_id")
        return partials.final_groups(found, hidden)

    def diagnose(self, first: int, second: int) -> DataFrame:
        """Why two entries do or don't match."""
        items = matching.with_mirrored(self.entries(), hashed=False).withColumn("ph_flip", F.col("ph"))
        return matching.explain_pair(items, first, second, match_settings(self.settings))

    # The table

    def db_stats(self) -> DataFrame:
        return cache.stats(self.entries())

    def db_list(self, part: str = "", offset: int = 0, limit: int = 200) -> DataFrame:
        rows = self.entries().select(F.col("id").cast("string").alias("id"), "name", "ext", "size", "flags")
        return review.page(review.listing(rows, part), ["id"], offset, limit)

    def _rewrite(self, ids: DataFrame, change: Callable[[DataFrame], DataFrame]) -> int:
        some = self.entries().join(ids.select("id").distinct(), "id", "left_semi")
        return store.save(change(some).select(*self._schema.fieldNames()), f"{self.folder}/entries")

    def db_exclude(self, ids: DataFrame, value: bool = True) -> int:
        return self._rewrite(ids, lambda e: cache.exclude(e, ids, value))

    def db_excluded(self) -> DataFrame:
        return cache.excluded(self.entries())

    def db_clear_entries(self, ids: DataFrame) -> int:
        return self._rewrite(ids, lambda e: cache.clear_entries(e, ids, DERIVED))

    def db_delete(self, ids: DataFrame) -> int:
        return store.save(self.spark.createDataFrame([], self._schema), f"{self.folder}/entries", deleted=ids.select("id"))

    def db_cleanup(self, library: DataFrame, keep_tombstones: bool = True) -> int:
        entries = self.entries()
        return self.db_delete(entries.join(cache.cleanup(entries, library, keep_tombstones).select("id"), "id", "left_anti").select("id"))

    def db_clear(self) -> int:
        return self.db_delete(self.entries().select("id"))

    def db_mark_deleted(self, ids: DataFrame, remember: bool = True) -> int:
        return self._rewrite(ids, lambda e: cache.mark_deleted(e, ids, remember))

    def db_restore_deleted(self, ids: DataFrame) -> int:
        return self._rewrite(ids, lambda e: cache.restore_deleted(e, ids))

    def db_failed(self) -> DataFrame:
        return cache.failed(self.entries())

    # The list of groups that are no matches: kept by a user, by hand, so it is a small file

    def not_a_match(self) -> list[list[int]]:
        return store.load_settings(self.spark, f"{self.folder}/not-a-match.json").get("sets", [])

    def _list_rows(self) -> DataFrame:
        return self.spark.createDataFrame([(i, s) for i, s in enumerate(self.not_a_match())], "set_id int, ids array<long>")

    def _save_list(self, sets: list[list[int]]) -> None:
        store.write_text(self.spark, f"{self.folder}/not-a-match.json", json.dumps({"sets": sets}))

    def not_a_match_add(self, ids: list[int]) -> int:
        sets = [*self.not_a_match(), sorted(set(ids))]
        self._save_list(sets)
        return len(sets)

    def not_a_match_remove(self, index: int) -> None:
        self._save_list([s for k, s in enumerate(self.not_a_match()) if k != index])

    def not_a_match_prune(self, library: DataFrame) -> int:
        """Drops sets with ids that the library lacks; returns how many."""
        before = self._list_rows()
        kept = [r["ids"] for r in results.prune_sets(before, library).orderBy("set_id").collect()]
        dropped = len(self.not_a_match()) - len(kept)
        self._save_list(kept)
        return dropped

    # Results and settings

    def results_save(self, rows: DataFrame, name: str = "results") -> None:
        if not name.replace("-", "").isalnum():
            raise ValueError("a name of letters, digits and dashes")
        store.save_results(rows, f"{self.folder}/{name}")

    def results_load(self, schema, name: str = "results") -> DataFrame:
        return store.load_results(self.spark, f"{self.folder}/{name}", schema)

    def in_scope(self, items: DataFrame, **more) -> DataFrame:
        return scope.scoped(items, self.settings, **more)

    def commands(self) -> dict[str, Callable]:
        """All commands by name."""
        names = [n for n in dir(self) if not n.startswith("_") and n not in ("commands", "spark", "folder", "settings")]
        return {n: getattr(self, n) for n in names}


class Presets:
    """Named values of a user (expressions, custom selections) and the last ones used."""

    def __init__(self, most_presets: int = 8, most_history: int = 20):
        self._named: dict[str, object] = {}
        self._history: list[object] = []
        self.most_presets, self.most_history = most_presets, most_history

    def save(self, name: str, value: object) -> None:
        self._named = {name: value} | {k: v for k, v in self._named.items() if k != name}

    def remove(self, name: str) -> None:
        self._named.pop(name, None)

    def top(self) -> list[str]:
        return list(self._named)[: self.most_presets]

    def get(self, name: str) -> object | None:
        return self._named.get(name)

    def used(self, value: object) -> None:
        self._history = [value, *(v for v in self._history if v != value)][: self.most_history]

    def history(self) -> list[object]:
        return list(self._history)
