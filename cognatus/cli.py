"""Command line: ``python -m cognatus.cli scan|lookup|verify|groups|members|search|toggle …``."""

from __future__ import annotations

import argparse
import sys

from cognatus.plans import verify as verification
from cognatus.plans.pipeline import scan
from cognatus.plans.store import LABELS, LookupFailed, Store
from cognatus.session import session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cognatus", description="Equivalent commits: scan, look up, verify.")
    sub = top.add_subparsers(dest="command")
    one = sub.add_parser("scan", help="bring a store up to a repository's head")
    one.add_argument("repo")
    one.add_argument("--full-history", action="store_true", help="link old, unstored commits again")
    one.add_argument("-j", "--jobs", help="local cores (default: all)", default="*")
    two = sub.add_parser("lookup", help="stats | HASH | GID | gGID | HASH HASH")
    two.add_argument("target", nargs="*")
    two.add_argument("-g", "--group", type=int, help="a group by its id, whatever else is given")
    two.add_argument("--exclusions", help="file of excluded hashes")
    three = sub.add_parser("verify", help="whether patch files name commits of one group")
    three.add_argument("folder")
    three.add_argument("-r", "--recursive", action="store_true")
    four = sub.add_parser("groups", help="groups, largest first")
    five = sub.add_parser("members", help="members of a group")
    five.add_argument("group", help="GID or gGID")
    six = sub.add_parser("toggle", help="exclude a group or a hash, or take it back")
    six.add_argument("target", help="gGID | HASH")
    seven = sub.add_parser("search", help="groups with commits whose message matches")
    seven.add_argument("repo")
    seven.add_argument("pattern", help="git's basic regular expression, case aside")
    for p in (four, five, seven):
        p.add_argument("--type", type=int, dest="kind", help="only members of this type of evidence")
        p.add_argument("--hide-excluded", action="store_true")
    for p in (four, five, six, seven):
        p.add_argument("--exclusions", required=p is six, help="file of excluded hashes")
    for p in (one, two, three, four, five, six, seven):
        p.add_argument("--store", default="cognatus-store")
        p.add_argument("--shared", help="folder that all executors see, for tables in between")
    return top


def main(argv: list[str] | None = None) -> int:
    arguments = parser().parse_args(argv)
    if not arguments.command:
        parser().print_help()
        return 0
    shared = {"spark.checkpoint.dir": arguments.shared} if arguments.shared else {}
    spark = session(master=f"local[{getattr(arguments, 'jobs', '*')}]", **shared)
    try:
        run = {"scan": _scan, "lookup": _lookup, "verify": _verify, "groups": _groups, "members": _members, "toggle": _toggle, "search": _search}
        return run[arguments.command](spark, arguments)
    except (LookupFailed, ValueError) as problem:
        print(f"Error: {problem}", file=sys.stderr)
        return 1


def _scan(spark, arguments) -> int:
    report = scan(spark, arguments.repo, Store.create(spark, arguments.store), full_history=arguments.full_history)
    if report is None:
        print("Nothing new.")
        return 0
    counted = {row["detection_type"]: row for row in report.counters.collect()}
    for kind, (_, label) in LABELS.items():
        row = counted.get(kind)
        print(f"{label:32}: {row['commits'] if row else 0} commits ({row['groups'] if row else 0} links)")
    print(f"{report.read} commits read, {report.compared} diffs compared, {report.filtered} members below the threshold")
    return 0


def _lookup(spark, arguments) -> int:
    store = Store.open(spark, arguments.store, arguments.exclusions)
    if arguments.group is not None:
        rows = store.group(arguments.group)
    elif arguments.target == ["stats"]:
        for name, df in store.stats().items():
            print(f"-- {name}")
            df.show(truncate=False)
        return 0
    elif len(arguments.target) == 2:
        return 0 if store.same_group(*arguments.target) else 1
    elif len(arguments.target) == 1:
        rows = store.lookup(arguments.target[0])
    else:
        raise LookupFailed("name a hash, a group or stats")
    for row in rows.toLocalIterator():
        print(row["sha"])
    return 0


def _list(store: Store, arguments, matches=None) -> int:
    for row in store.groups(arguments.kind, arguments.hide_excluded, matches).toLocalIterator():
        print(f"g{row['group_id']}\t{row['cnt']}\t{row['mark']}".rstrip())
    return 0


def _groups(spark, arguments) -> int:
    return _list(Store.open(spark, arguments.store, arguments.exclusions), arguments)


def _group_id(asked: str) -> int:
    digits = asked.strip().lower().removeprefix("g")
    if not digits.isdigit():
        raise LookupFailed(f"{asked!r} is no group")
    return int(digits)


def _members(spark, arguments) -> int:
    store = Store.open(spark, arguments.store, arguments.exclusions)
    for row in store.members(_group_id(arguments.group), arguments.kind, arguments.hide_excluded).toLocalIterator():
        print(f"{row['sha']}\t{row['label']}\t{row['shown']}{chr(9) + 'excluded' if row['is_excluded'] else ''}")
    return 0


def _toggle(spark, arguments) -> int:
    store = Store.open(spark, arguments.store, arguments.exclusions)
    target = arguments.target.strip().lower()
    left = store.toggle(gid=_group_id(target)) if target.startswith("g") else store.toggle(sha=target)
    print(f"{left.count()} hashes excluded")
    return 0


def _search(spark, arguments) -> int:
    store = Store.open(spark, arguments.store, arguments.exclusions)
    found, matches, stored = store.search_repository(arguments.repo, arguments.pattern)
    print(f"{matches} commits match, {stored} of them stored")
    return _list(store, arguments, found)


def _verify(spark, arguments) -> int:
    store = Store.open(spark, arguments.store)
    summary, failures = verification.verify(spark, arguments.folder, store.hashes, arguments.recursive)
    summary.show()
    for row in failures.toLocalIterator():
        print(f"{row['path']}: {row['reason']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
