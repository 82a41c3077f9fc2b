"""Pedigrees (individuals and relationships) and taxonomies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

PARENT, DERIVED = "PARENT_CHILD", "ORIGINAL_DERIVED"


def families(individuals: DataFrame, relationships: DataFrame, sloppy: bool = False) -> DataFrame:
    """(child, father, mother) of children with exactly two parents.

    Individuals: (id, sex, ..); relationships: (first, second, type).  Father and mother
    follow from sex; where that doesn't tell, ``sloppy`` takes the first parent as father,
    and otherwise the child is left out.
    """
    pairs = relationships.where(F.col("type") == PARENT).select(F.col("second").alias("child"), F.col("first").alias("id"))
    sexed = pairs.join(individuals.select("id", "sex"), "id", "left")
    both = sexed.groupBy("child").agg(F.array_sort(F.collect_list(F.struct("id", "sex"))).alias("p")).where(F.size("p") == 2)
    a, b = F.col("p")[0], F.col("p")[1]
    straight, crossed = (a["sex"] == "male") & (b["sex"] == "female"), (a["sex"] == "female") & (b["sex"] == "male")
    known = F.coalesce(straight | crossed, F.lit(False))
    out = both if sloppy else both.where(known)
    cross = F.coalesce(crossed, F.lit(False))
    return out.select("child", F.when(cross, b["id"]).otherwise(a["id"]).alias("father"), F.when(cross, a["id"]).otherwise(b["id"]).alias("mother"))


def nuclear(fams: DataFrame) -> DataFrame:
    """One row per pair of parents, with their children."""
    return fams.groupBy("father", "mother").agg(F.array_sort(F.collect_list("child")).alias("children"))


def monogamous(fams: DataFrame) -> DataFrame:
    """Parents and with how many partners they have children; monogamous ones have one."""
    who = fams.select(F.col("father").alias("id"), F.col("mother").alias("partner")).unionByName(fams.select(F.col("mother").alias("id"), F.col("father").alias("partner")))
    return who.groupBy("id").agg(F.count_distinct("partner").alias("partners"))


def _kept(df: DataFrame, label: str) -> DataFrame:
    """The frame written and reread, so that rounds don't repeat each other's work."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def generations(individuals: DataFrame, relationships: DataFrame) -> DataFrame:
    """(id, generation): founders have 0, others one more than their deepest parent; families are processed in this order.

    One round for each generation; a round holds every individual once, however many paths
    lead to it.  Relationships with a null end count for nothing; a cycle is an error.
    """
    edges = relationships.where((F.col("type") == PARENT) & F.col("first").isNotNull() & F.col("second").isNotNull()).select("first", "second").distinct()
    level = individuals.select("id").distinct().join(edges.select(F.col("second").alias("id")).distinct(), "id", "left_anti")
    most, depth, out = individuals.count(), 0, level.withColumn("depth", F.lit(0))
    while True:
        level = _kept(level.join(edges, level["id"] == edges["first"]).select(F.col("second").alias("id")).distinct(), "generation")
        if not level.head(1):
            break
        depth += 1
        if depth > most:
            raise ValueError("the relationships have a cycle")
        out = out.unionByName(level.withColumn("depth", F.lit(depth)))
    return out.groupBy("id").agg(F.max("depth").alias("generation"))


def filter_pedigree(individuals: DataFrame, primary: bool = False, families_: Iterable[str] | None = None, ids: Iterable[str] | None = None, sex: str | None = None) -> DataFrame:
    """Individuals for whom all the given conditions hold."""
    out = individuals.where("primary_") if primary else individuals
    for column, values in (("family", families_), ("id", ids), ("sex", [sex] if sex else None)):
        if values is not None:
            out = out.where(F.col(column).isin(list(values)))
    return out


def relationships_among(individuals: DataFrame, relationships: DataFrame, drop_parents: bool = False) -> DataFrame:
    """Relationships whose both ends are left; without parentage if asked."""
    ids = individuals.select("id")
    kept = relationships.join(ids.withColumnRenamed("id", "first"), "first", "left_semi").join(ids.withColumnRenamed("id", "second"), "second", "left_semi")
    return kept.where(F.col("type") != PARENT) if drop_parents else kept


def id_list(individuals: DataFrame, relationships: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """Union of the ids of some kinds: primary, male, female, paternal, maternal, founder."""
    parents = relationships.where(F.col("type") == PARENT)
    as_parent = individuals.join(parents.select(F.col("first").alias("id")).distinct(), "id", "left_semi")
    has_parent = parents.select(F.col("second").alias("id")).distinct()
    lists = {
        "primary": individuals.where("primary_"), "male": individuals.where("sex = 'male'"), "female": individuals.where("sex = 'female'"),
        "paternal": as_parent.where("sex = 'male'"), "maternal": as_parent.where("sex = 'female'"),
        "founder": individuals.join(has_parent, "id", "left_anti"),
    }
    out = None
    for kind in kinds:
        part = lists[kind].select("id")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def summary(individuals: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row: members, by sex, founders, affected, parents' pairs."""
    parents = relationships.where(F.col("type") == PARENT)
    marked = individuals.join(parents.select(F.col("second").alias("id")).distinct().withColumn("child_", F.lit(True)), "id", "left")
    return marked.agg(
        F.count("*").alias("members"), F.count_if(F.col("sex") == "male").alias("males"), F.count_if(F.col("sex") == "female").alias("females"),
        F.count_if(F.col("child_").isNull()).alias("founders"), F.count_if(F.coalesce(F.col("affected"), F.lit(False))).alias("affected"), F.count_distinct("family").alias("families"),
    )


def antecedents(relationships: DataFrame) -> DataFrame:
    """(id, antecedent): the originals of derived samples, and parents."""
    return relationships.where(F.col("type").isin(PARENT, DERIVED)).select(F.col("second").alias("id"), F.col("first").alias("antecedent")).distinct()


def graphviz(individuals: DataFrame, relationships: DataFrame) -> str:
    """The pedigree as Graphviz text (a pedigree is small; it is read on the driver)."""
    shape = {"male": "box", "female": "ellipse"}
    lines = [f'  "{r["id"]}" [shape={shape.get(r["sex"], "diamond")}];' for r in individuals.select("id", "sex").orderBy("id").toLocalIterator()]
    lines += [f'  "{r["first"]}" -> "{r["second"]}"{"" if r["type"] == PARENT else " [style=dashed]"};' for r in relationships.orderBy("first", "second").toLocalIterator()]
    return "digraph pedigree {\n" + "\n".join(lines) + "\n}\n"


# ------------------------------------------------------------------ taxonomy: (id, parent, rank, name); the root's parent is -1 or null


def lineage(nodes: DataFrame, ids: Iterable[int] | None = None) -> DataFrame:
    """(id, ancestor, steps) for the nodes asked for (or every node) and each of their ancestors, themselves included.

    Links of 1, 2, 4, .. steps come from joining links with themselves; each kind doubles how far
    the rows reach, so the number of rounds is the logarithm of the depth.  The rows are the nodes
    times their depth, each written once at most.  Parents that are no node are told too; where a
    node is given twice, every way up counts (``ways``).  A cycle above a node asked for is an error.
    """
    taxa = _kept(nodes.select("id", F.nullif("parent", F.lit(-1)).alias("up")), "taxa")
    start = taxa.select("id") if ids is None else taxa.select("id").where(F.col("id").isin(list(ids)))
    links, most = [taxa.where("id is not null and up is not null").groupBy("id", "up").agg(F.count("*").alias("ways"))], taxa.count()
    while links[-1].head(1):
        if 2 ** (len(links) - 1) > most:
            # Only what runs into a cycle has links of more steps than there are nodes.
            if start.join(links[-1], "id", "left_semi").head(1):
                raise ValueError("the taxonomy has a cycle")
            break
        over = links[-1].select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("ways").alias("ways2"))
        longer = links[-1].join(over, "up").groupBy("id", F.col("up2").alias("up"))
        # Ways round a cycle can outgrow a long.
        links.append(_kept(longer.agg(F.try_sum(F.try_multiply("ways", "ways2")).alias("ways")), "links"))
    out = start.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("steps"), F.lit(1).cast("long").alias("ways"))
    for k, link in enumerate(links[:-1]):
        over = link.select(F.col("id").alias("ancestor"), "up", F.col("ways").alias("ways2"))
        further = out.join(over, "ancestor").select("id", F.col("up").alias("ancestor"), (F.col("steps") + 2**k).alias("steps"), (F.col("ways") * F.col("ways2")).alias("ways"))
        out = out.unionByName(further if k == len(links) - 2 else _kept(further, "lineage"))
    return out.withColumn("way_", F.explode(F.array_repeat(F.lit(0), F.col("ways").cast("int")))).drop("ways", "way_")


def _below(nodes: DataFrame, roots: Iterable[int]) -> DataFrame:
    """Ids at or under the roots.

    Every node looks at its parent, then at whatever that one looks at, so the number of
    rounds is the logarithm of the depth, and a round holds every node once.
    """
    at = _kept(nodes.select("id", F.nullif("parent", F.lit(-1)).alias("up"), F.col("id").isin(list(roots)).alias("hit")), "taxa")
    while at.where("up is not null and not hit").head(1):
        over = at.select(F.col("id").alias("up"), F.when(~F.col("hit"), F.col("up")).alias("up2"), F.col("hit").alias("hit2"))
        at = _kept(at.join(over, "up", "left").select("id", F.when(~F.col("hit"), F.col("up2")).alias("up"), (F.col("hit") | F.coalesce("hit2", F.lit(False))).alias("hit")), "taxa")
    return at.where("hit").select("id").distinct()


def subtree(nodes: DataFrame, roots: Iterable[int]) -> DataFrame:
    """The nodes at or under the roots."""
    return nodes.join(_below(nodes, roots), "id", "left_semi")


def subset(nodes: DataFrame, ids: Iterable[int]) -> DataFrame:
    """The nodes that are an id or an ancestor of one: the least tree over them."""
    return nodes.join(lineage(nodes, ids).select(F.col("ancestor").alias("id")).distinct(), "id", "left_semi")


def prune(nodes: DataFrame, roots: Iterable[int]) -> DataFrame:
    """The nodes not at or under the roots."""
    return nodes.join(_below(nodes, roots), "id", "left_anti")


def invalid(nodes: DataFrame) -> DataFrame:
    """(id, problem): ids found twice, parents that don't exist, names that are missing, roots beyond the first."""
    twice = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    linked = nodes.where("parent is not null and parent != -1")
    orphan = linked.join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", F.lit("no such parent").alias("problem"))
    blank = nodes.where("name is null or name = ''").select("id", F.lit("no name").alias("problem"))
    roots = nodes.where("parent is null or parent = -1").select("id")
    extra = roots.join(roots.agg(F.min("id").alias("id")), "id", "left_anti").select("id", F.lit("another root").alias("problem"))
    return twice.unionByName(orphan).unionByName(blank).unionByName(extra)
