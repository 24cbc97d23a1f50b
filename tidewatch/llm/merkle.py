"""Merkle dataset manifest: a tree of digests over the rows of each group, and one over the groups' roots, with a proof for each row.

A forest holds nodes keyed by level and index whose siblings it has not met. Merging
forests puts their nodes together and folds each run of siblings as soon as it is
whole; how many make a run is known from the group's size, so the last run of a level
needs no mark. Which rows a forest started from makes no difference, so merging is
associative, and forests of parts of a table are reduced as a tree: rows are sorted by
range, cut into fragments of bounded size, each fragment's nodes are folded, and what
is unresolved (a few nodes a level at both ends) goes on to the next round, which
merges fragments of a range, then ranges, MERGED at a time. Rounds are grouped jobs
instead of a reduce on the driver, as folded runs are needed again: each node that a
round takes in keeps its siblings up to the node that it became part of, and on the
way back down the proofs are joined to the fragments' rows.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests go in as hex text.
A row's leaf is H of its fields, each `-` if null, else UTF-8 byte count, `:` and value
(decimal for integers). Rows of a group ascend by the order column, nulls first, rows
with equal order by their leaf; repeated rows are leaves of their own. Groups ascend by
UTF-8 bytes, the null group first. An empty table has no rows and no root. Texts are
hashed whole by Spark and not moved. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

#: Siblings of a run, rows of a fragment, ranges that a round merges, rows of a range.
ARITY, FRAGMENT, MERGED, RANGE = 3, 20_000, 16, 200_000
#: Fields of a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BLOCKS = 1 << 20  # fragments of a range


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """H of a row's fields."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def level_sizes(n: int, arity: int = ARITY) -> list[int]:
    """Nodes on each level of a tree of n leaves; the last level is the root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // arity))
    return out


class Forest:
    """Nodes of one group by (level, index); runs are folded when they are whole.

    steps tells of each folded node its place in its run, its siblings and what it became.
    """

    def __init__(self, n: int, arity: int = ARITY):
        self.sizes, self.arity = level_sizes(n, arity), arity
        self.open: dict[tuple[int, int], str] = {}
        self.steps: dict[tuple[int, int], str] = {}

    def add(self, level: int, index: int, found: str) -> None:
        while True:
            self.open[level, index] = found
            if level == len(self.sizes) - 1:
                return
            begin = index // self.arity * self.arity
            run = [(level, k) for k in range(begin, min(begin + self.arity, self.sizes[level]))]
            if any(node not in self.open for node in run):
                return
            digests = [self.open.pop(node) for node in run]
            for k, node in enumerate(run):
                self.steps[node] = f"{k}:" + "".join(digests[:k] + digests[k + 1 :])
            level, index, found = level + 1, index // self.arity, digest(digests)

    def path(self, level: int, index: int) -> tuple[list[str], int, int]:
        """Steps from a node up, and the level and index of the open node above it."""
        out = []
        while (level, index) in self.steps:
            out.append(self.steps[level, index])
            level, index = level + 1, index // self.arity
        return out, level, index


def fold(found: str, path: list[str]) -> str:
    """The root from a leaf and its path."""
    for step in path:
        place, siblings = step.split(":")
        run = [siblings[k : k + 64] for k in range(0, len(siblings), 64)]
        run.insert(int(place), found)
        found = digest(run)
    return found


def siblings(path: list[str]) -> str:
    """All digests of a path, in order."""
    return "".join(step.split(":")[1] for step in path)


def _forests(rows: list[dict], arity: int) -> dict[int, Forest]:
    """A forest for each group (its number) of rows with grp, n, level, idx and digest."""
    out: dict[int, Forest] = {}
    for r in rows:
        if r["grp"] not in out:
            out[r["grp"]] = Forest(r["n"], arity)
        out[r["grp"]].add(r["level"], r["idx"], r["digest"])
    return out


_NODE = "src long, grp long, n long, level int, idx long, digest string"
_UP = f"frag long, {_NODE}, path array<string>, up_level int, up_idx long, up_digest string, lead boolean"
_UP_ARROW = pa.schema([("frag", pa.int64()), ("src", pa.int64()), ("grp", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("path", pa.list_(pa.string())), ("up_level", pa.int32()), ("up_idx", pa.int64()), ("up_digest", pa.string()), ("lead", pa.bool_())])


def merged(nodes: DataFrame, arity: int, leads_only: bool) -> DataFrame:
    """nodes (frag, src, ...) with the open node that each became within its fragment; lead marks one node below each open one. leads_only drops the others, and all paths."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        forests, seen, out = _forests(rows, arity), set(), []
        for r in rows:
            f = forests[r["grp"]]
            path, level, idx = f.path(r["level"], r["idx"])
            lead = (r["grp"], level, idx) not in seen
            seen.add((r["grp"], level, idx))
            if lead or not leads_only:
                out.append(r | {"path": [] if leads_only else path, "up_level": level, "up_idx": idx, "up_digest": f.open[level, idx], "lead": lead})
        return pa.Table.from_pylist(out, _UP_ARROW)

    return nodes.groupBy("frag").applyInArrow(run, _UP)


def numbered(leaves: DataFrame, ranges: int) -> DataFrame:
    """leaves (grp_key, ord, leaf, ...) with grp (its rank in order, from 0), n (rows of the group), idx (place in it) and frag, stored.

    Counts by fragment and group give each fragment's first place, so no group is sorted or counted in one task.
    """
    order = [F.col("grp_key").asc_nulls_first(), F.col("ord").asc_nulls_first(), F.col("leaf").asc(), F.col("tie").asc()]
    ranged = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("tie")
    kept = stored(ranged.withColumn("seq", F.monotonically_increasing_id()), "leaves")
    cut = kept.withColumn("frag", F.floor(F.col("seq") / (1 << 33)) * _BLOCKS + F.floor(F.col("seq") % (1 << 33) / FRAGMENT))
    key = [F.coalesce("grp_key", F.lit("")).alias("key"), F.col("grp_key").isNull().alias("none")]
    counts = stored(cut.groupBy("frag", *key).agg(F.count("*").alias("rows"), F.min("seq").alias("first")), "fragments")
    inside = Window.partitionBy("none", "key").orderBy("frag").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy("none", "key").agg(F.sum("rows").alias("n"), F.min("first").alias("grp"))  # the first row's place in the table's order numbers a group
    starts = counts.select("frag", "none", "key", (F.coalesce(F.sum("rows").over(inside), F.lit(0)) - F.col("first")).alias("base")).join(sizes, ["none", "key"])
    return cut.select("*", *key).join(starts, ["frag", "none", "key"]).withColumn("idx", F.col("seq") + F.col("base")).drop("none", "key", "base", "seq")


#: What made() gets: a row, its path to the root of all and that root.
Made = Callable[[dict, list[str], str], dict]


def proofs(leaves: DataFrame, made: Made, result: str, arrow: pa.Schema, above: Callable[[DataFrame], DataFrame] | None = None, arity: int = ARITY) -> DataFrame:
    """What made() says of each leaf, as rows of schema result (arrow: the same for Arrow).

    leaves: grp_key (string), ord, leaf, and whatever else made needs. above gets the groups'
    roots (grp, grp_key, subroot) and returns grp, top (path from the group's root up) and root;
    without it each group stands for itself.
    """
    rows = stored(numbered(leaves, max(1, -(-leaves.count() // RANGE))), "numbered")
    nodes = rows.select("frag", F.col("frag").alias("src"), "grp", "n", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"))
    rounds = [stored(merged(nodes, arity, True), "forest")]
    widest, divisor = rounds[0].agg(F.max("frag")).first()[0], _BLOCKS
    while widest is not None and widest > 0 or len(rounds) == 1:
        lower = rounds[-1].where("lead")
        nodes = lower.select(F.floor(F.col("frag") / divisor).alias("frag"), F.col("frag").alias("src"), "grp", "n", F.col("up_level").alias("level"), F.col("up_idx").alias("idx"), F.col("up_digest").alias("digest"))
        rounds.append(stored(merged(nodes, arity, False), "forest"))
        widest, divisor = (widest or 0) // divisor, MERGED
    roots = rounds[-1].where("lead").select("grp", F.col("up_digest").alias("subroot"))
    if above:
        names = rows.where("idx = 0").select("grp", "grp_key")
        tops = stored(above(stored(roots.join(names, "grp"), "subroots")), "tops")
    else:
        tops = roots.select("grp", F.array().cast("array<string>").alias("top"), F.col("subroot").alias("root"))
    # and down again: what is left of a node's path is the path of what it became
    left = rounds[-1].join(tops, "grp").select("src", "grp", "level", "idx", F.concat("path", "top").alias("path"), "root")
    for lower in reversed(rounds[1:-1]):
        over = left.select("grp", F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), F.col("path").alias("rest"), "root")
        left = lower.join(over, ["grp", "up_level", "up_idx"]).select("src", "grp", "level", "idx", F.concat("path", "rest").alias("path"), "root")

    def run(own: pa.Table, open_nodes: pa.Table) -> pa.Table:
        over = {(r["grp"], r["level"], r["idx"]): r for r in open_nodes.to_pylist()}
        table = own.to_pylist()
        forests, out = _forests([r | {"level": 0, "digest": r["leaf"]} for r in table], arity), []
        for r in table:
            path, level, idx = forests[r["grp"]].path(0, r["idx"])
            rest = over[r["grp"], level, idx]
            out.append(made(r, path + rest["path"], rest["root"]))
        return pa.Table.from_pylist(out, arrow)

    return rows.groupBy("frag").cogroup(left.withColumnRenamed("src", "frag").groupBy("frag")).applyInArrow(run, result)


def manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, arity: int = ARITY, tampered: dict[str, Column] | None = None) -> DataFrame:
    """A row for each document: its order column, leaf, subroot, root, proof (siblings from the leaf up, as `place:digests`) and folded_root, the root that follows from the leaf of the tampered fields (or else its own) and the proof.

    tampered: for some fields, what they are believed to be now; a manifest is checked by giving the present values.
    """
    now = [(tampered or {}).get(c, F.col(f"`{c}`")) for c in fields]
    leaves = docs.select(F.col(f"`{group}`").cast("string").alias("grp_key"), F.col(f"`{order}`").alias("ord"), leaf(*[F.col(f"`{c}`") for c in fields]).alias("leaf"), leaf(*now).alias("now"))
    kind = docs.schema[order].dataType

    def over(roots: DataFrame) -> DataFrame:
        said = lambda r, path, root: {"grp": r["below"], "top": path, "root": root, "subroot": r["leaf"]}
        names = pa.schema([("grp", pa.int64()), ("top", pa.list_(pa.string())), ("root", pa.string()), ("subroot", pa.string())])
        up = roots.select(F.lit(None).cast("string").alias("grp_key"), F.col("grp_key").alias("ord"), F.col("subroot").alias("leaf"), F.col("grp").alias("below"))
        # the group's own root goes with the path, as its last step's marker would be lost
        return proofs(up, said, "grp long, top array<string>, root string, subroot string", names, None, arity).select("grp", F.concat(F.array(F.concat(F.lit("="), "subroot")), "top").alias("top"), "root")

    def said(r: dict, path: list[str], root: str) -> dict:
        mark = next(k for k, step in enumerate(path) if step[0] == "=")
        steps = path[:mark] + path[mark + 1 :]
        return {"ord": r["ord"], "leaf": r["leaf"], "subroot": path[mark][1:], "root": root, "proof": steps, "folded_root": fold(r["now"], steps)}

    from pyspark.sql.pandas.types import to_arrow_type

    names = pa.schema([("ord", to_arrow_type(kind)), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof", pa.list_(pa.string())), ("folded_root", pa.string())])
    out = proofs(leaves, said, f"ord {kind.simpleString()}, leaf string, subroot string, root string, proof array<string>, folded_root string", names, over, arity)
    return out.withColumnRenamed("ord", order)


def proof_digest(proof: Column) -> Column:
    """H of all siblings of a proof."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.substring_index(step, ":", -1)), "").cast("binary"), 256)
