"""python -m crossfile.cli check|score|summary|page [PACKAGE], flow|reach NAMES, saved

Without a package, the one in the current folder is read. ``saved`` takes an editor's save event, {"tool_input": {"file_path": ...}}
or {"file_path": ...}, from stdin and tells what is new and what is fixed; it never fails.
"""

from __future__ import annotations

import argparse
import dataclasses
import hashlib
import json
import sys
import tempfile
from pathlib import Path

from crossfile.plans import report
from crossfile.rules import project_for
from crossfile.sources.gitlog import SOURCES
from pyspark.sql import SparkSession


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    what = p.add_subparsers(dest="what", required=True)
    for name in ("check", "score", "summary", "page", "flow", "reach"):
        c = what.add_parser(name)
        if name == "flow":
            c.add_argument("names", nargs="+")
        elif name == "reach":
            c.add_argument("names", nargs=1)
        if name in ("flow", "reach"):
            c.add_argument("--package", type=Path)
        else:
            c.add_argument("package", type=Path, nargs="?")
        c.add_argument("--library", action="store_true", help="every public name is a door")
        c.add_argument("--facts", help="JSON lines that another language's reader has written")
        c.add_argument("--json", action="store_true")
    what.add_parser("saved")
    return p


def _memory(file: Path) -> Path:
    return Path(tempfile.gettempdir()) / "crossfile-told" / f"{hashlib.sha1(str(file).encode()).hexdigest()[:16]}.json"


def saved(text: str) -> str:
    """The note on a save event. What was told of a file is kept beside the editor, where the event comes from."""
    try:
        event = json.loads(text)
        path = (event.get("tool_input") or event).get("file_path")
        if not isinstance(path, str) or not path.endswith(SOURCES):
            return ""
        file = Path(path).resolve()
        at = _memory(file)
        told = set(json.loads(at.read_text())) if at.exists() else set()
        said, now = report.saved(_session(), file, told)
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(json.dumps(sorted(now)))
        return said
    except Exception as e:  # noqa: BLE001 - a half-written file must not stop an editor; the next save is read again
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return ""


def _session() -> SparkSession:
    return SparkSession.builder.appName("crossfile").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    a = _arguments().parse_args(argv)
    if a.what == "saved":
        if said := saved(sys.stdin.read()):
            print(said)
        return 0
    spark = _session()
    try:
        rules = project_for(a.package)
        f = report.load(spark, dataclasses.replace(rules, library=rules.library or a.library), a.facts)
        if a.what == "flow":
            print(report.flow_text(f, a.names))
            return 0
        if a.what == "reach":
            rows = report.reach(f, a.names[0]).collect()
            print("\n".join(f"{r.hops} hops: {' > '.join(p.partition(':')[2] for p in r.path)}" for r in rows))
            print(f"{len(rows)} doors reach it", file=sys.stderr)
            return 0
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    r = report.reading(f)
    if a.what == "summary":
        print(report.markdown(r))
    elif a.what == "page":
        print(json.dumps(report.payload(r)))
    elif a.what == "score":
        print(json.dumps(report.score_json(r), indent=1) if a.json else "\n".join(f"{x.label:8} {x.value:3}  {x.detail}".rstrip() for x in r.axes.collect()))
    else:
        lines, counts = report.check_text(r)
        print(json.dumps(report.check_json(r), indent=1) if a.json else "\n".join(lines))
        print("\n".join(counts), file=sys.stderr)
        return int(bool(lines))
    return 0


if __name__ == "__main__":
    sys.exit(main())
