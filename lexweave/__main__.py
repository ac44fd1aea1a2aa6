"""``python -m lexweave FOLDER search|grep|read|refs|define|map|status|validate|index ...``: the verbs on a folder of Parquet tables."""

from __future__ import annotations

import argparse
import json
import sys

from lexweave.engine import Engine, NotFound
from lexweave.session import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexweave")
    p.add_argument("folder")
    p.add_argument("verb", choices=["search", "grep", "read", "refs", "define", "map", "status", "validate", "index"])
    p.add_argument("what", nargs="*")
    for flag in ("scope", "source", "kind", "as-of", "direction"):
        p.add_argument(f"--{flag}")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--depth", type=int, default=None)
    p.add_argument("--complete", action="store_true", help="map: everything below")
    p.add_argument("--max-hits", type=int, default=None)
    p.add_argument("--annotate", action="store_true", help="grep: the paragraph of each line")
    p.add_argument("-i", action="store_true", help="case-blind")
    p.add_argument("-w", action="store_true", help="whole words")
    p.add_argument("-F", action="store_true", help="literal patterns")
    p.add_argument("-c", action="store_true", help="counts only")
    a = p.parse_args(argv)
    e = Engine.of(session(), a.folder)
    what = " ".join(a.what)
    try:
        if a.verb == "read":
            print(json.dumps(e.read(what, a.as_of), ensure_ascii=False, indent=1))
            return 0
        out = {
            "search": lambda: e.search(what, a.limit, as_of=a.as_of, scope=a.scope, source=a.source, kind=a.kind),
            "grep": lambda: e.grep(a.what, a.F, a.w, a.i, a.scope, count_only=a.c, max_hits=a.max_hits, annotate=a.annotate),
            "refs": lambda: e.refs(what, a.direction or "both", a.depth or 1, as_of=a.as_of),
            "define": lambda: e.define(what, a.scope, a.as_of),
            "map": lambda: e.map_complete(a.scope or what) if a.complete else e.map(a.scope or what or None, a.depth or 3),
            "status": e.status,
            "validate": e.validate,
            "index": lambda: e.spark.createDataFrame([(e.build_index(a.scope or f"{a.folder}/_index").segments()[-1]["documents"],)], "documents bigint"),
        }[a.verb]()
    except NotFound as err:
        print(f"not found: {err}", file=sys.stderr)
        return 1
    n = 0
    for r in out.toLocalIterator():
        print(json.dumps(r.asDict(), ensure_ascii=False, default=str))
        n += 1
    return 0 if n else 1


if __name__ == "__main__":
    sys.exit(main())
