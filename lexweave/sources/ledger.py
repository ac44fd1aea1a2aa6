"""A ledger of runs on the shared file system: receipts that are never changed, locks per source, runs that go on where they
stopped (SURVEY I8, I9, I11, W26)."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession

from lexweave.session import fs_of, put_if_absent, read_text, remove

RECEIPT = "run string, stage string, attempt int, state string, input_key string, output string, at_ns bigint"


class Ledger:
    """Every receipt is a file of its own, made once with its content; the ledger is what the receipts say."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        fs, p = fs_of(self.spark, f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(".")) if fs.exists(p) else []

    def begin(self, source: str, key: str) -> str:
        """The run that processes ``key`` of a source: the same id however often it is begun."""
        run = f"{source}~{key}"
        put_if_absent(self.spark, f"{self.root}/runs/{run}", json.dumps({"source": source, "key": key}))
        return run

    def lock(self, source: str, owner: str, stale_after: float = 3600.0) -> bool:
        """Take the lock of a source, unless another owner holds it and has shown itself within ``stale_after`` seconds."""
        path, text = f"{self.root}/locks/{source}", json.dumps({"owner": owner, "at": time.time()})
        if put_if_absent(self.spark, path, text):
            return True
        held = json.loads(read_text(self.spark, path))
        if held["owner"] != owner and time.time() - held["at"] < stale_after:
            return False
        remove(self.spark, path)
        return put_if_absent(self.spark, path, text)

    def unlock(self, source: str, owner: str) -> None:
        path = f"{self.root}/locks/{source}"
        if source in self._names("locks") and json.loads(read_text(self.spark, path))["owner"] == owner:
            remove(self.spark, path)

    def receipt(self, run: str, stage: str, state: str, input_key: str, output: str = "") -> int:
        """Add a receipt; its attempt. Receipts have no way to be changed or taken back."""
        attempt = 1 + sum(n.startswith(f"{stage}~") for n in self._names(f"receipts/{run}"))
        while True:
            row = {"run": run, "stage": stage, "attempt": attempt, "state": state, "input_key": input_key, "output": output, "at_ns": time.time_ns()}
            if put_if_absent(self.spark, f"{self.root}/receipts/{run}/{stage}~{attempt:06d}", json.dumps(row)):
                return attempt
            attempt += 1

    def done(self, run: str, stage: str, input_key: str) -> str | None:
        """Output of the newest receipt of a stage if that is complete and of the same input; None if the stage is to be run."""
        names = [n for n in self._names(f"receipts/{run}") if n.startswith(f"{stage}~")]
        last = json.loads(read_text(self.spark, f"{self.root}/receipts/{run}/{names[-1]}")) if names else {}
        return last["output"] if last.get("state") == "complete" and last["input_key"] == input_key else None

    def receipts(self) -> DataFrame:
        """All receipts as a table."""
        if not self._names("receipts"):
            return self.spark.createDataFrame([], RECEIPT)
        return self.spark.read.schema(RECEIPT).option("recursiveFileLookup", "true").json(f"{self.root}/receipts")
