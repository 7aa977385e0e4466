"""States of a keyed table as runs that are merged by size.

``runs/v=<write>`` hold folded states, ``versions/<number>`` name the runs that count. A delivery adds
one run; whenever ``FAN`` runs of a level are together they are merged into one of the next, so the
runs to read grow with the logarithm of the deliveries. A source's deliveries are numbered and the
manifest keeps the last number of each, so a delivery that is sent again changes nothing.
"""

from pyspark.sql import DataFrame

from quizlens.sources.versioned import Versioned, due, fresh_name


class History(Versioned):
    def __init__(self, spark, path, fold, keep=4):
        super().__init__(spark, path)
        self.fold, self.keep = fold, keep

    def folders_of(self, manifest):
        return {f"runs/v={run['write']}" for run in manifest["runs"]}

    def _read(self, runs):
        return self.spark.read.parquet(*(f"{self.path}/runs/v={run['write']}" for run in runs))

    def _write(self, states, level):
        name = fresh_name("r")
        self.fold.merge(states).write.parquet(f"{self.path}/runs/v={name}")
        return {"write": name, "level": level}

    def append(self, messages: DataFrame, source: str, number: int):
        """Add the states of a source's delivery; deliveries of one source come in the order of their numbers."""
        based_on = max(self.versions(), default=0)
        manifest = self.manifest(based_on) or {"runs": [], "last": {}}
        if number <= manifest["last"].get(source, -1):
            return
        runs = manifest["runs"] + [self._write(self.fold.lift(messages), 0)]
        while (group := due([run["level"] for run in runs])) is not None:
            first, last = group
            merged = self._write(self._read(runs[first:last]), runs[first]["level"] + 1)
            runs = runs[:first] + [merged] + runs[last:]
        self.commit(based_on, {"runs": runs, "last": manifest["last"] | {source: number}})

    def tidy(self):
        """Remove runs that the last ``keep`` versions no longer name."""
        self.vacuum(self.keep)

    def states(self, version=None) -> DataFrame:
        """One state row per key: all runs merged."""
        manifest = self.manifest(version)
        if not manifest:
            raise FileNotFoundError(f"nothing was written to {self.path} yet")
        return self.fold.merge(self._read(manifest["runs"]))

    def read(self, version=None) -> DataFrame:
        """The finished keyed table."""
        return self.fold.finish(self.states(version))
