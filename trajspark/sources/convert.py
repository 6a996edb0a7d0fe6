"""Convert trusted gzip-pickle agent runs to JSON lines: python -m trajspark.sources.convert FOLDER OUT.

Runs on one machine, never in executors. Pickles are read with an unpickler that knows no classes, so they can hold plain values only.
"""

from __future__ import annotations

import gzip
import json
import pickle
import sys
from pathlib import Path


class Plain(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"{module}.{name} in a run; only plain values are read")


def episodes(path: Path) -> list[dict]:
    """The episodes of one file; the file's name stands in for a missing task_template."""
    with gzip.open(path, "rb") as stream:
        return [{"task_template": path.name.removesuffix(".pkl.gz")} | e for e in Plain(stream).load()]


def convert(folder: str, out: str) -> int:
    """One JSON-lines file for all *.pkl.gz of a folder, or of its first run_* folder; the number of episodes."""
    files = sorted(Path(folder).glob("*.pkl.gz"))
    if not files and (runs := sorted(Path(folder).glob("run_*"))):
        files = sorted(runs[0].glob("*.pkl.gz"))
    every = [e for f in files for e in episodes(f)]
    Path(out).write_text("".join(json.dumps(e) + "\n" for e in every))
    return len(every)


if __name__ == "__main__":
    print(convert(*sys.argv[1:3]))
