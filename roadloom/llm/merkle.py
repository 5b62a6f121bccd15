"""Merkle manifest of a table: a digest for every row, a tree over each group's rows, a tree over the groups.

Built bottom-up: the rows of a group are numbered in order, FAN consecutive nodes are one run, a run's digest is a
node of the next level. A level is a stored table of runs, joined from children to parents. Proofs are pushed top-down: a
run inherits the proof suffix of its node one level up, and each child prepends its siblings there. What travels is a row
for each run, not for each row of the table; groups of any size are spread over all tasks, since runs are the keys.

H is sha256 in lowercase hex of the concatenated inputs, digests as their hex text.

Defined results: nulls in any column are leaves like others (a null is `-`, an empty text `0:`); a null id comes first
in its group, a null group is one of its own and the first; repeated rows are leaves of their own, side by side; an
empty table has no leaves and gives an empty result; a single row is its own subroot, a single subroot the root, with
an empty proof; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators.prefix import numbered

from . import common

FAN = 8
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left: string, right: string>>"


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def leaf(columns: list[Column]) -> Column:
    """H of the columns, each `-` if null, else the number of its bytes in UTF-8, a colon and its value."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def _run(nodes: DataFrame, *carried: str) -> DataFrame:
    """g, run, n, items: FAN consecutive nodes (g, place, n, node, carried columns) a row, in order."""
    item = F.struct("place", "node", *carried)
    runs = nodes.groupBy("g", F.floor(F.col("place") / FAN).alias("run"))
    return runs.agg(F.first("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items"))


def _nodes(items: Column) -> Column:
    return F.transform(items, lambda x: x["node"])


@dataclass
class Tree:
    """The stored levels of the trees of all groups, leaves first, and their tops (g, top)."""

    levels: list[DataFrame]
    tops: DataFrame

    @staticmethod
    def build(nodes: DataFrame, root: str, name: str, *carried: str) -> Tree:
        """nodes: g, place (from 0 within g), n (nodes of g), node (a digest), carried columns."""
        levels = [common.store(_run(nodes, *carried), f"{name}_0", root)]
        most = levels[0].agg(F.max("n")).head()[0] or 1
        while most > 1:
            # groups that are down to one node are done
            up = levels[-1].where("n > 1").select(
                "g", F.col("run").alias("place"), F.ceil(F.col("n") / FAN).alias("n"), digest(F.array_join(_nodes(F.col("items")), "")).alias("node")
            )
            levels.append(common.store(_run(up), f"{name}_{len(levels)}", root))
            most = -(-most // FAN)
        tops = None
        for level in levels:
            own = level.where("n = 1").select("g", F.col("items")[0]["node"].alias("top"))
            tops = own if tops is None else tops.unionByName(own)
        return Tree(levels, tops)

    def pushed(self, tops: DataFrame) -> DataFrame:
        """g, n, x (item of a leaf), path, and the further columns of tops (g, path, ...), where path is what the tops
        inherit. A path holds what stands left and right of the node in its run, level by level upwards."""
        more = [c for c in tops.columns if c not in ("g", "path")]
        above: DataFrame | None = None  # g, run, path: the nodes of the level above, by the runs that they stand for
        for level in reversed(self.levels):
            out = level.where("n = 1").join(tops, "g")
            if above is not None:
                out = out.unionByName(level.where("n > 1").join(above, ["g", "run"]))
            each = out.select("g", "n", "path", *more, F.posexplode("items").alias("k", "x"), F.col("items").alias("run_items"))
            before = F.array_join(F.slice(_nodes(F.col("run_items")), F.lit(1), F.col("k")), "")
            after = F.array_join(F.slice(_nodes(F.col("run_items")), F.col("k") + 2, F.lit(FAN)), "")
            here = F.array(F.struct(before.alias("left"), after.alias("right")))
            path = F.when(F.col("n") > 1, F.concat(here, "path")).otherwise(F.col("path"))
            each = each.select("g", "n", "x", path.alias("path"), *more)
            above = each.select("g", F.col("x.place").alias("run"), "path", *more)
        return each


def proof_digest(path: Column) -> Column:
    """H of the siblings, level by level upwards, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf_: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf_, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


@dataclass
class Manifest:
    groups: Tree
    subroots: Tree
    root: str

    def subroot_nodes(self) -> DataFrame:
        """g, subroot, root, path of the subroots."""
        whole = self.subroots.tops.select(F.lit(0).alias("g"), F.col("top").alias("root"), F.array().cast(PATH).alias("path"))
        each = self.subroots.pushed(whole)
        return each.select(F.col("x.group").alias("g"), F.col("x.node").alias("subroot"), "root", "path")

    def proofs(self) -> DataFrame:
        """x (place, node, id and carried columns of a leaf), subroot, root, path."""
        tops = common.store(self.subroot_nodes(), "subroot_paths", self.root)
        return self.groups.pushed(tops).select("x", "subroot", "root", "path")


def manifest(rows: DataFrame, *carried: str, root: str | None = None) -> Manifest:
    """rows: g (a text that names the group and orders it), id, node (digest of the row), carried columns."""
    root = root or common.shared_dir(rows.sparkSession)
    keep = lambda name: lambda df: common.store(df, name, root)
    leaves = numbered(rows.select("g", "id", "node", *carried), ["id", "node"], ["g"], total="n", keep=keep("leaves"))
    groups = Tree.build(leaves, root, "level", "id", *carried)
    tops = numbered(groups.tops, ["g"], total="n", keep=keep("tops"))
    tops = tops.select(F.lit(0).alias("g"), "place", "n", F.col("top").alias("node"), F.col("g").alias("group"))
    return Manifest(groups, Tree.build(tops, root, "top", "group"), root)


def group_name(c: Column) -> Column:
    """Orders a null first, then values by their bytes."""
    return F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def audited(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row proven against the root, every third
    (by its id) after tampering with its text."""
    root = common.shared_dir(docs.sparkSession)
    columns = {c: F.col(c) for c in COLUMNS}
    tampered = columns | {"text": F.translate("text", UPPER, LOWER)}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select(*COLUMNS).select(
        group_name(F.col("lang")).alias("g"), F.col("doc_id").alias("id"), leaf([*columns.values()]).alias("node"), F.when(chosen, leaf([*tampered.values()])).alias("found")
    )
    # texts are read once; what follows handles digests alone
    rows = common.store(rows, "digests", root)
    each = manifest(rows, "found", root=root).proofs()
    each = each.select(
        F.col("x.id").alias("doc_id"), F.col("x.node").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce(F.col("x.found"), F.col("x.node")), F.col("path")).alias("folded_root"),
    )
    return each.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves, per language. Null ids are leaves (not tampered with), null texts stay as they are,
    repeated rows are leaves of their own, an empty table gives an empty one."""
    return audited(common.table(spark, sf_dir, "documents"))


#: Levels that the SQL unrolls: groups of up to FAN ** SQL_LEVELS rows.
SQL_LEVELS = 7
_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LOWER = f"translate(text, '{UPPER}', '{LOWER}')"
# of the bytes of the decimal id, eight steps a byte; 3988292384 is the reversed polynomial
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(len(doc_id::VARCHAR)), lambda i:
  [ascii(substr(doc_id::VARCHAR, CAST(i AS BIGINT) + 1, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""


def _climb_sql(k: int, source: str) -> str:
    """Level k of every leaf: its node there, the siblings so far, and the folded value."""
    return f""", s{k} AS (SELECT g, p, n, any_value(node) AS node FROM {source} GROUP BY g, p, n),
 r{k} AS (SELECT g, p // 8 AS run, list(node ORDER BY p) AS items FROM s{k} WHERE n > 1 GROUP BY g, p // 8),
 l{k} AS (SELECT l.* EXCLUDE (p, n, node, proof, fold), CASE WHEN n > 1 THEN p // 8 ELSE p END AS p, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE n END AS n,
  CASE WHEN n > 1 THEN sha256(array_to_string(items, '')) ELSE node END AS node,
  CASE WHEN n > 1 THEN proof || array_to_string(items[1 : p % 8], '') || array_to_string(items[p % 8 + 2 :], '') ELSE proof END AS proof,
  CASE WHEN n > 1 THEN sha256(array_to_string(items[1 : p % 8], '') || fold || array_to_string(items[p % 8 + 2 :], '')) ELSE fold END AS fold
  FROM {source} l LEFT JOIN r{k} r ON r.g = l.g AND r.run = l.p // 8 AND l.n > 1)"""


OP11_SQL = (
    f"""WITH a AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS lg, sha256({" || ".join(_FIELD.format(c) for c in COLUMNS)}) AS leaf,
  CASE WHEN {_CRC} % 3 = 0 THEN sha256({" || ".join(_FIELD.format(c) for c in [*COLUMNS[:-1], _LOWER])}) END AS found FROM documents),
 l0 AS (SELECT doc_id, leaf, lg AS g, row_number() OVER (PARTITION BY lg ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lg) AS n,
  leaf AS node, '' AS proof, coalesce(found, leaf) AS fold FROM a)"""
    + "".join(_climb_sql(k, f"l{k - 1}") for k in range(1, SQL_LEVELS + 1))
    + f""", m AS (SELECT *, node AS subroot, (SELECT count(DISTINCT g) FROM l{SQL_LEVELS}) AS langs, dense_rank() OVER (ORDER BY g) - 1 AS place FROM l{SQL_LEVELS}),
 m0 AS (SELECT doc_id, leaf, subroot, 0 AS g, place AS p, langs AS n, node, proof, fold FROM m)"""
    + "".join(_climb_sql(k, "m0" if k == 11 else f"l{k - 1}") for k in range(11, 14))
    + " SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = node AS verified FROM l13"
)
