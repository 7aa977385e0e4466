"""Keyed tables that are kept up to date: one state row per key, by day and by part of the keys.

Below the store's path lie

``rows/v=<write>/dt=<day>/part=<n>``  state rows; a *cell* is one day of one part
``keys/v=<write>``                    which day the rows of the written keys lie in
``versions/<number>``                 a manifest: the write that holds each cell, and the key lists

A write first looks up the days of its keys, then merges its states with the stored rows of those
keys, and writes the touched cells anew; a row whose day moved leaves its old cell in the same write.
The manifest comes last, so a write that fails changes nothing. The rows of a touched cell that are
not written again pass on without a shuffle, unless a write has very many keys. Key lists are merged by size.
"""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizlens.sources.versioned import Versioned, due, fresh_name

NO_DAY = "__HIVE_DEFAULT_PARTITION__"
FEW_KEYS = 1_000_000        # of a write, sent to the tasks that read the touched cells; of more all rows are merged


class KeyedStore(Versioned):
    """``fold`` merges states; ``moment`` is the state column (of kind ``lowest``) whose day places a row.

    ``parts`` is fixed when the store is made: a late message rewrites one part of one day, so busy days want more.
    """

    def __init__(self, spark, path, fold, moment, parts=1):
        super().__init__(spark, path)
        self.fold, self.moment, self.parts = fold, moment, parts

    def folders_of(self, manifest):
        rows = {f"rows/v={write}" for write in manifest["cells"].values()}
        return rows | {f"keys/v={entry['write']}" for entry in manifest["keys"]}

    # -------------------------------------------------------------- reading
    def _rows(self, manifest, cells):
        """State rows of some cells (a cell's name: its write), with ``dt`` and ``part``."""
        schema = T.StructType.fromJson(manifest["schema"])
        placed = T.StructType([*schema, T.StructField("dt", T.DateType()), T.StructField("part", T.IntegerType())])
        if not cells:
            return self.spark.createDataFrame([], placed)
        paths = [f"{self.path}/rows/v={write}/{cell}" for cell, write in sorted(cells.items())]
        reader = self.spark.read.schema(T.StructType([*placed, T.StructField("v", T.StringType())]))
        return reader.option("basePath", f"{self.path}/rows").parquet(*paths).drop("v")

    def states(self, start=None, end=None, version=None) -> DataFrame:
        """Stored states of the days from ``start`` to ``end`` (dates or ISO texts, both included)."""
        manifest = self.manifest(version)
        if not manifest:
            raise FileNotFoundError(f"nothing was written to {self.path} yet")
        low, high = (d.isoformat() if isinstance(d, date) else d for d in (start, end))

        def wanted(cell):
            day = cell.split("/")[0].removeprefix("dt=")
            if day == NO_DAY:
                return low is None and high is None
            return (low is None or day >= low) and (high is None or day <= high)

        return self._rows(manifest, {c: w for c, w in manifest["cells"].items() if wanted(c)})

    def read(self, start=None, end=None, version=None) -> DataFrame:
        """The finished table with its ``dt`` column; no fold and no shuffle is left to do.

        Keys that no message has placed on a day yet are not part of it.
        """
        rows = self.states(start, end, version).where(F.col("dt").isNotNull())
        return self.fold.finish(rows, "dt")

    # -------------------------------------------------------------- writing
    def _listed(self, entries):
        """Rows of key lists; ``_age`` grows from the oldest to the newest."""
        every = None
        for age, entry in enumerate(entries):
            one = self.spark.read.parquet(f"{self.path}/keys/v={entry['write']}").withColumn("_age", F.lit(age))
            every = one if every is None else every.unionByName(one)
        return every

    def _newest(self, listed):
        return listed.groupBy(self.fold.key).agg(F.max_by("dt", "_age").alias("dt"))

    def _compacted(self, entries):
        """The key lists, with those that are due for it merged into one."""
        while (group := due([e["level"] for e in entries])) is not None:
            first, last = group
            name = fresh_name("k")
            self._newest(self._listed(entries[first:last])).write.parquet(f"{self.path}/keys/v={name}")
            entries = entries[:first] + [{"write": name, "level": entries[first]["level"] + 1}] + entries[last:]
        return entries

    def _placed(self, rows):
        """``rows`` with their day and part."""
        part = F.pmod(F.xxhash64(self.fold.key), F.lit(self.parts)).cast("int").alias("part")
        return rows.select("*", F.to_date(self.moment).alias("dt"), part)

    def _write_rows(self, whole, write):
        """Write the rows of whole cells; returns them as written, and the cells."""
        prefix = f"rows/v={write}/"
        placed = self._placed(whole).hint("rebalance", F.col("dt"), F.col("part"))
        placed.write.partitionBy("dt", "part").parquet(f"{self.path}/{prefix}")
        cells = {n.removeprefix(prefix): write for n in self.folder.names(f"{prefix}dt=*/part=*")}
        return self.spark.read.parquet(f"{self.path}/{prefix}") if cells else None, cells

    def _write_keys(self, written, write):
        now = written.where(F.col(self.fold.key).isNotNull()).select(self.fold.key, F.to_date(self.moment).alias("dt"))
        now.write.parquet(f"{self.path}/keys/v={write}")
        return {"write": write, "level": 0}

    def _changed(self, fresh, old, keys, few):
        """The rows of cells that hold ``old`` after ``fresh`` states of some ``keys``.

        Rows of other keys pass on as they are. If the keys are too many to send, all rows are merged: the merge
        of one state is that state, and one shuffle of all rows costs less than finding those of the keys.
        """
        if not few:
            return self.fold.merge(fresh.unionByName(old))
        changed = self.fold.merge(fresh.unionByName(old.join(keys, self.fold.key, "left_semi")))
        return changed.unionByName(old.join(keys, self.fold.key, "left_anti"))

    def _first(self, states, write, based_on, manifest):
        """An upsert into a store without rows: there is nothing to look up, so the states are merged and written once."""
        merged = self.fold.merge(states)
        written, cells = self._write_rows(merged, write)
        if not cells:
            if manifest["schema"] is None:      # an empty table is a table
                self.commit(based_on, manifest | {"schema": merged.schema.jsonValue()})
            return cells
        schema = written.drop("dt", "part").schema.jsonValue()
        self.commit(based_on, {"cells": cells, "keys": [self._write_keys(written, write)], "schema": schema})
        return cells

    def upsert(self, states: DataFrame):
        """Merge lifted ``states`` (``fold.lift(messages)``) into the store; atomic, and safe to repeat.

        Returns the days whose rows may have changed, those that rows moved away from included.
        """
        key, write = self.fold.key, fresh_name("w")
        based_on = max(self.versions(), default=0)
        manifest = self.manifest(based_on) or {"cells": {}, "keys": [], "schema": None}
        days_of = lambda cells: sorted({cell.split("/")[0].removeprefix("dt=") for cell in cells} - {NO_DAY})
        if not manifest["cells"] and not manifest["keys"]:
            return days_of(self._first(states, write, based_on, manifest))

        self.fold.merge(states).write.parquet(f"{self.path}/fresh/v={write}")
        fresh = self.spark.read.parquet(f"{self.path}/fresh/v={write}")
        keys = fresh.select(key)
        n_keys = keys.count()
        if not n_keys:
            return []
        few = n_keys <= FEW_KEYS
        if few:
            keys = F.broadcast(keys)

        touched = self._placed(fresh).select("dt", "part")
        if manifest["keys"]:
            known = self._newest(self._listed(manifest["keys"]).join(keys, key, "left_semi"))
            part = F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int").alias("part")
            touched = touched.unionByName(known.select("dt", part))
        # at most one row a cell
        touched = {f"dt={r['dt'] or NO_DAY}/part={r['part']}" for r in touched.distinct().collect()}
        held = {c: w for c, w in manifest["cells"].items() if c in touched}
        if held:
            old = self._rows(manifest, held).drop("dt", "part")
            written, now = self._write_rows(self._changed(fresh, old, keys, few), write)
            entry = self._write_keys(written.join(keys, key, "left_semi"), write)
        else:
            written, now = self._write_rows(fresh, write)
            entry = self._write_keys(written, write)

        cells = {c: w for c, w in manifest["cells"].items() if c not in touched} | now
        entries = self._compacted(manifest["keys"] + [entry])
        self.commit(based_on, {"cells": cells, "keys": entries, "schema": fresh.schema.jsonValue()})
        self.folder.remove(f"fresh/v={write}")
        return days_of(touched)

    def drop_days(self, before):
        """Retention: forget the days before ``before`` (ISO text); their keys start anew if they come again."""
        based_on = max(self.versions(), default=0)
        manifest = self.manifest(based_on)
        kept = {c: w for c, w in manifest.get("cells", {}).items() if c.startswith(f"dt={NO_DAY}") or c >= f"dt={before}"}
        if kept != manifest.get("cells", {}):
            self.commit(based_on, manifest | {"cells": kept})
