"""Verification of a consumer's imports against a provider's exports, by the rules of each engine.

References are signed: below zero an import (-1 is the first), above zero an export, zero the package itself. An import's
parent is verified before it, without recursion, with cycles and lost parents found on the way. Both tables of one
(consumer, provider) pair meet in one task: they are no larger than two packages' own tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import MISSING, PACKAGE_ONLY, RESOLVED, UNRESOLVED

#: Outcome of each status.
OUTCOMES = {"resolved": RESOLVED, "package": PACKAGE_ONLY, "private_export": MISSING, "missing": MISSING, "runtime_only": UNRESOLVED, "unresolved": UNRESOLVED, "invalid": UNRESOLVED, "ignored": UNRESOLVED}
#: Class packages that stand for one another, and the class that a mesh may have become. Fixed values.
SAME_PACKAGES, MESH = frozenset({"unreali", "unrealshare"}), ("mesh", "lodmesh")
REDIRECTOR = "objectredirector"
#: Results that a task hands on at once, or those of one pair.
ROWS = 10_000


@dataclass(frozen=True)
class Rules:
    """What differs between engines."""

    public_bit: int = 0
    later_exports_first: bool = False
    root_needs_core: bool = True
    none_name: str = "ignored"
    positive_outer: str = "invalid"
    outer_may_be_zero: bool = False
    #: equal; pair (equal, or one pair of names); full_or_any (equal where any is, else whatever)
    class_package: str = "equal"
    mesh_retry: bool = False
    redirectors: bool = False
    private_needs_reference: bool = False
    no_match: str = "runtime_only"


RULES = {
    1: Rules(outer_may_be_zero=True, class_package="pair", mesh_retry=True),
    2: Rules(outer_may_be_zero=True, class_package="pair", mesh_retry=True, later_exports_first=True),
    3: Rules(public_bit=34, positive_outer="unresolved", redirectors=True, private_needs_reference=True),
    4: Rules(root_needs_core=False, none_name="unresolved", positive_outer="unresolved", class_package="full_or_any", no_match="missing"),
    5: Rules(root_needs_core=False, positive_outer="unresolved", redirectors=True, no_match="missing"),
}


@dataclass
class Provider:
    """Exports by name and class, in the order that the engine looks at them."""

    rules: Rules
    buckets: dict = field(default_factory=dict)

    def fill(self, exports: list[tuple]) -> Provider:
        """exports: (index, object name, class name, class package, outer, flags)."""
        for e in sorted(exports, key=lambda e: -e[0] if self.rules.later_exports_first else e[0]):
            self.buckets.setdefault((e[1].lower(), e[2].lower()), []).append(e)
        return self

    def _package_fits(self, wanted: str, found: list[tuple]) -> list[tuple]:
        equal = [e for e in found if (e[3] or "").lower() == wanted]
        if self.rules.class_package == "pair":
            return [e for e in found if (e[3] or "").lower() == wanted or {wanted, (e[3] or "").lower()} <= SAME_PACKAGES]
        return found if self.rules.class_package == "full_or_any" and not equal else equal

    def find(self, name: str, cls: str, package: str, parent: int | None) -> list[tuple]:
        """Exports that fit; parent: the export that the import's outer resolved to, None for the package itself."""
        at = 0 if parent is None else parent + 1
        found = self._package_fits(package.lower(), self.buckets.get((name.lower(), cls.lower()), []))
        return [e for e in found if e[4] == at or self.rules.outer_may_be_zero and e[4] == 0]


def _one(row: tuple, parent: tuple | None, provider: Provider) -> tuple[str, str | None, int | None]:
    """Status, reason and export of an import whose parent's result is known."""
    rules, (_, name, cls, package, outer, referenced) = provider.rules, row
    if any(x is None or x.lower() == "none" for x in (name, cls, package)):
        return rules.none_name, "none_name", None
    if outer > 0:
        return rules.positive_outer, "export_outer", None
    if outer == 0:
        fits = cls.lower() == "package" and (not rules.root_needs_core or package.lower() == "core")
        return ("package", None, None) if fits else ("invalid", "root_class", None)
    if parent[0] not in ("package", "resolved"):
        return "unresolved", "parent", None
    found = provider.find(name, cls, package, parent[2])
    if not found and rules.mesh_retry and cls.lower() == MESH[0]:
        found = provider.find(name, MESH[1], package, parent[2])
    if found:
        public = found[0] if rules.class_package != "full_or_any" else next((e for e in found if e[5] >> rules.public_bit & 1), found[0])
        if public[5] >> rules.public_bit & 1:
            return "resolved", None, public[0]
        return ("private_export", "private", None) if referenced or not rules.private_needs_reference else ("runtime_only", "private_unreferenced", None)
    if rules.redirectors and (name.lower(), REDIRECTOR) in provider.buckets:
        return "unresolved", "redirector", None
    return rules.no_match, "no_match", None


def verify_pair(imports: list[tuple], exports: list[tuple], engine: int) -> list[tuple]:
    """imports: (index, object name, class name, class package, outer, referenced). Results: (index, status, reason, export)."""
    provider, rows = Provider(RULES[engine]).fill(exports), {r[0]: r for r in imports}
    done: dict[int, tuple] = {}
    for start in rows:
        path, seen, i, broken = [], set(), start, None
        while i not in done:
            if i not in rows:
                broken = "lost_parent"
                break
            if i in seen:
                broken = "cycle"
                break
            path.append(i)
            seen.add(i)
            if rows[i][4] >= 0:
                break
            i = -rows[i][4] - 1
        # only a cycle's own imports, or the one whose parent is lost, are broken; those below have an unresolved parent
        cut = path.index(i) if broken == "cycle" else len(path) - 1 if broken else len(path)
        for k in range(len(path) - 1, -1, -1):
            j = path[k]
            outer = rows[j][4]
            done[j] = ("unresolved", broken, None) if k >= cut else _one(rows[j], done.get(-outer - 1) if outer < 0 else None, provider)
    return [(i, *done[i]) for i in rows]


def verify_imports(imports: DataFrame, exports: DataFrame, engine: int) -> DataFrame:
    """pair_id, index, status, reason, export_index of every import. imports: pair_id, index, object_name, class_name,
    class_package, outer_index, referenced; exports: pair_id, index, object_name, class_name, class_package, outer_index, flags."""
    return verify_engines(imports, exports, [engine]).drop("engine")


def verify_engines(imports: DataFrame, exports: DataFrame, engines: Iterable[int]) -> DataFrame:
    """verify_imports by the rules of several engines, with their number as column engine: pairs are dealt and read once.

    A task reads its pairs one after another in Arrow batches of any number of pairs, so a small pair costs no frame of its
    own."""
    names, engines = ["index", "object_name", "class_name", "class_package", "outer_index"], list(engines)
    side = lambda df, n, referenced, flags: df.select("pair_id", F.lit(n).alias("side"), *names, referenced.cast("boolean").alias("referenced"), flags.cast("long").alias("flags"))
    rows = side(imports, 0, F.col("referenced"), F.lit(None)).unionByName(side(exports.where("object_name IS NOT NULL AND class_name IS NOT NULL"), 1, F.lit(None), F.col("flags")))
    kinds = {"pair_id": pa.int64(), "engine": pa.int32(), "index": pa.int32(), "status": pa.string(), "reason": pa.string(), "export_index": pa.int32()}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for pair, group in groupby((row for batch in it for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=itemgetter(0)):
            left, right = [], []
            for _, exported, *row, referenced, flags in group:
                (right if exported else left).append((*row, flags if exported else referenced))
            for engine in engines if left else ():
                out += [(pair, engine, *r) for r in verify_pair(left, right, engine)]
            if len(out) >= ROWS:
                yield _batch(out, kinds)
                out = []
        if out:
            yield _batch(out, kinds)

    # dealt by a hash of the pair: by the pair itself Spark takes the two sides, where each is dealt so, as dealt together,
    # and adaptive execution then parts them
    dealt = rows.repartition(F.xxhash64("pair_id")).sortWithinPartitions("pair_id", "side", "index")
    return dealt.mapInArrow(run, "pair_id long, engine int, index int, status string, reason string, export_index int")


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


def outcome(status: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])[status]


def resolve_hashed(imports: DataFrame, packages: DataFrame, exports: DataFrame, scripts: DataFrame) -> DataFrame:
    """Imports by identifiers, as containers of engine 5 have them: no names, no recursion, equality joins only.

    imports: file_id, index, kind (script, package or null), package_id, export_hash, script_id; packages: package_id,
    provider; exports: package_id, export_hash; scripts: script_id. The first provider by identifier wins, as mount order
    is given by it. Adds provider and outcome."""
    first = packages.groupBy("package_id").agg(F.min("provider").alias("provider"))
    known = exports.select("package_id", "export_hash").distinct().withColumn("has_export", F.lit(True))
    script = scripts.select("script_id").distinct().withColumn("has_script", F.lit(True))
    joined = imports.join(first, "package_id", "left").join(known, ["package_id", "export_hash"], "left").join(script, "script_id", "left")
    by_package = F.when(F.col("has_export"), RESOLVED).when(F.col("provider").isNotNull(), PACKAGE_ONLY).otherwise(MISSING)
    result = F.when(F.col("kind") == "script", F.when(F.col("has_script"), RESOLVED).otherwise(MISSING)).when(F.col("kind") == "package", by_package).otherwise(UNRESOLVED)
    return joined.select("file_id", "index", "kind", F.when(F.col("kind") == "package", F.col("provider")).alias("provider"), result.alias("outcome"))
