"""A Merkle manifest of a table: every row is a leaf, with a proof up to one root.

Leaves of a group (of ``documents``: a language) stand in a fixed order.  They are
dealt into blocks of ``2 ** bits`` consecutive ones, and each block is collapsed
level by level with higher-order functions (sequence, transform, slice and
aggregate) in the row that holds it.  The block roots are the leaves of the next
round, so a round leaves ``2 ** -bits`` of the rows; the group's last node is its
subroot, and the subroots are collapsed in the same way to the root.  A run of two
nodes becomes the hash of both, a last run of one the hash of that one.

Ranks within a group come from a range sort by group and order, counts of the
ranges, and a running number within each range, so that no group is one task: a
block is at most ``2 ** bits`` digests, whatever the size of its group.  Texts are
read once, to hash them; only ids and digests are shuffled.

Defined results: a null field is hashed as ``-``; an empty text is ``0:``.  Null
groups are a group of their own, first, and null order keys stand first.  Rows of
one order key stand by leaf, so that the root doesn't depend on the input's
order; repeated rows are leaves of their own with proofs of their own.  A group of
one leaf has that leaf as its subroot, and an empty table gives no rows.  Other
columns of the table, whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 10
#: The fields of a leaf of ``documents``, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range of the sort, about.
RANGE_ROWS = 100_000


def sized(c: Column) -> Column:
    """UTF-8 byte count, colon and value; a hyphen if null."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*[sized(c) for c in fields]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""

    def step(node: Column, s: Column) -> Column:
        other = F.coalesce(s["sibling"], F.lit(""))
        return F.sha2(F.when(s["left"], F.concat(other, node)).otherwise(F.concat(node, other)), 256)

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    """Hash of the siblings that there are, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["sibling"]), ""), 256)


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes(grp, ...) with rank (from 0) and n (nodes) within their group."""
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, nodes.count() // RANGE_ROWS + 1)
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    nodes = written(nodes.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    counts = nodes.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("c"))
    of = Window.partitionBy("grp")
    counts = counts.select(F.col("grp").alias("g"), F.col("part").alias("p"), F.sum("c").over(of).alias("n"), (F.sum("c").over(of.orderBy("part")) - F.col("c")).alias("before"))
    local = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*keys[1:])) - 1
    nodes = nodes.withColumn("local", local)
    return nodes.join(counts, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p"))).withColumn("rank", F.col("before") + F.col("local")).drop("part", "g", "p", "before", "local")


def collapsed(leaves: Column, steps: Column) -> Column:
    """All levels of a block, the leaves first: each step hashes runs of two."""

    def parents(level: Column) -> Column:
        runs = F.sequence(F.lit(1), F.ceil(F.size(level) / 2).cast("int"))
        return F.transform(runs, lambda j: F.sha2(F.array_join(F.slice(level, 2 * j - 1, F.lit(2)), ""), 256))

    up = F.aggregate(F.sequence(F.lit(1), steps), F.array(leaves), lambda levels, _: F.concat(levels, F.array(parents(F.element_at(levels, -1)))))
    return F.when(steps > 0, up).otherwise(F.array(leaves))


def block_path(levels: Column, pos: Column, steps: Column) -> Column:
    """(sibling, left) of each level for the leaf at pos; sibling is null where a run is one node."""

    def step(k: Column) -> Column:
        at = F.call_function("shiftright", pos, k)
        return F.struct(F.get(F.get(levels, k), at.bitwiseXOR(F.lit(1))).alias("sibling"), (at % 2 == 1).alias("left"))

    empty = F.array().cast("array<struct<sibling:string,left:boolean>>")
    return F.when(steps > 0, F.transform(F.sequence(F.lit(0), steps - 1), step)).otherwise(empty)


def blocks(nodes: DataFrame, bits: int, carry: list[str]) -> DataFrame:
    """nodes(grp, rank, n, node, carry) -> grp, block, n, items, levels, steps; a
    block has its group's number of levels, at most ``bits``."""
    # the smallest number of halvings that leaves one node of n
    steps = F.least(F.lit(bits), F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0)).cast("int")
    rows = nodes.groupBy("grp", "n", F.call_function("shiftright", F.col("rank"), F.lit(bits)).alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "node", *carry))).alias("items"))
    rows = rows.withColumn("steps", steps)
    return rows.withColumn("levels", collapsed(F.col("items.node"), F.col("steps")))


def merkle_tree(nodes: DataFrame, order: list[str], bits: int = BITS) -> DataFrame:
    """nodes(grp, node, ...) -> with subroot and path (siblings up to the subroot)."""
    carry = [c for c in nodes.columns if c not in ("grp", "node")]
    rounds = [written(blocks(ranked(nodes, order), bits, carry), "merkle-blocks")]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1 << bits:
        below = rounds[-1]
        roots = below.select("grp", F.col("block").alias("rank"), F.ceil(F.col("n") / (1 << bits)).alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
        rounds.append(written(blocks(roots, bits, []), "merkle-blocks"))
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        b = rounds[k]
        if above is None:
            top = F.element_at(F.element_at("levels", -1), 1)
            b = b.withColumns({"subroot": top, "rest": F.array().cast("array<struct<sibling:string,left:boolean>>")})
        else:
            up = above.select(F.col("grp").alias("g"), F.col("rank").alias("r"), "subroot", F.col("path").alias("rest"))
            b = b.join(up, F.col("grp").eqNullSafe(F.col("g")) & (F.col("block") == F.col("r")))
        rows = b.select("grp", "levels", "steps", "subroot", "rest", F.posexplode("items").alias("pos", "item"))
        path = F.concat(block_path(F.col("levels"), F.col("pos"), F.col("steps")), F.col("rest"))
        above = rows.select("grp", "subroot", path.alias("path"), "item.*")
    return above.drop("n", "rank")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", claims: dict[str, Column] | None = None, bits: int = BITS) -> DataFrame:
    """grp, key, leaf, claims, subroot, root, path (from the leaf to the root).

    ``claims`` are further digests of a row, such as the leaf that a copy of it
    would have; they are carried to be verified against its path.
    """
    claims = claims or {}
    # equal rows are told apart, so that many copies of one row are dealt to many tasks
    leaves = docs.select(F.col(group).alias("grp"), F.col(key).alias("key"), leaf_hash(*[F.col(c) for c in fields]).alias("node"), *[c.alias(n) for n, c in claims.items()], F.monotonically_increasing_id().alias("tie"))
    rows = merkle_tree(written(leaves, "merkle-leaves"), ["key", "node", "tie"], bits)
    rows = written(rows, "merkle-paths")
    # the groups themselves are leaves of one tree, in the order of their names
    groups = rows.groupBy("grp").agg(F.first("subroot").alias("node")).select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "node")
    tops = merkle_tree(groups, ["name"], bits).select("name", F.col("subroot").alias("root"), F.col("path").alias("rest"))
    rows = rows.join(tops, F.col("grp").eqNullSafe(F.col("name")))
    return rows.select("grp", "key", F.col("node").alias("leaf"), *claims, "subroot", "root", F.concat("path", "rest").alias("path"))


def tampered_manifest(docs: DataFrame, every: int = 7) -> DataFrame:
    """Proofs of all documents, verified against copies of which those whose
    unsigned crc32 of the id is divisible by ``every`` have n_chars raised by one."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    changed = F.when(hit, F.col("n_chars").cast("long") + 1).otherwise(F.col("n_chars").cast("long"))
    claim = leaf_hash(*[changed if c == "n_chars" else F.col(c) for c in FIELDS])
    rows = manifest(docs, claims={"claim": claim})
    rows = rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.col("claim"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(every: int = 7) -> str:
    """DuckDB SQL for op13: plain recursion level by level, siblings by join."""

    def part(x: str) -> str:
        return f"coalesce(strlen(cast({x} as varchar))::varchar || ':' || cast({x} as varchar), '-')"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(part(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"

    def tree(name: str, base: str, key: str) -> str:
        """All nodes of the trees of base(key, i, n, h)."""
        return f"""{name} as (select {key}, 0 as level, i, n, h from {base}
union all select {key}, level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' order by i)) from {name} where n > 1 group by {key}, level, i // 2)"""

    return f"""
with recursive crc_table as (select list(c order by i) as t from (select i, list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) r(i))),
d as (select *, row_number() over () as row, coalesce(xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(cast(doc_id as varchar)) + 1), lambda k: cast(ord(cast(doc_id as varchar)[k]) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {every} = 0, false) as hit from documents, crc_table),
l as (select row, doc_id, lang, {leaf("n_chars")} as leaf, {leaf("(n_chars + case when hit then 1 else 0 end)")} as claim from d),
leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf, row) - 1 as i, count(*) over (partition by lang) as n, leaf as h, dense_rank() over (order by lang nulls first) - 1 as g from l),
{tree("low", "leaves", "g")},
subroots as (select 0 as one, g as i, (select max(g) + 1 from leaves) as n, h from low where n = 1),
{tree("high", "subroots", "one")},
steps as (select a.row, k.level, s.h as sibling, (a.i >> k.level) % 2 = 1 as is_left from leaves a join (select distinct g, level from low where n > 1) k on k.g = a.g left join low s on s.g = a.g and s.level = k.level and s.i = xor(a.i >> k.level, 1)
union all select a.row, 1000 + k.level, s.h, (a.g >> k.level) % 2 = 1 from leaves a, (select distinct level from high where n > 1) k left join high s on s.level = k.level and s.i = xor(a.g >> k.level, 1)),
paths as (select row, list(struct_pack(sibling, is_left) order by level) as path, string_agg(sibling, '' order by level) as siblings from steps group by row),
fold as (select row, claim as h, coalesce(path, []) as path from l left join paths using (row)
union all select row, case when path[1].is_left then sha256(coalesce(path[1].sibling, '') || h) else sha256(h || coalesce(path[1].sibling, '')) end, path[2:] from fold where len(path) > 0),
r as (select h as root from high where n = 1)
select a.doc_id, a.leaf, s.h as subroot, root, sha256(coalesce(siblings, '')) as proof_sha256, f.h as folded_root, f.h = root as verified
from leaves a join subroots s on s.i = a.g join fold f on f.row = a.row and len(f.path) = 0 left join paths p on p.row = a.row, r"""
