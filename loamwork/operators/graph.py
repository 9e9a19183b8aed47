"""Property graph as node and edge tables: building, visibility, bounded expansion, explanation, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamwork import session
from loamwork.functions import access, text
from loamwork.operators import entities, match

# Kinds of relations between entities that may be stored, and those that expansion follows unless told otherwise.
RELATIONS = ["DEPENDS_ON", "CALLS", "OWNS", "IMPLEMENTS", "AFFECTS"]
FOLLOWED = ["CONTAINS", "MENTIONS", "DOCUMENTED_IN", *RELATIONS]
NODE = ["uri", "type", "name", "workspace_id", "acl_allow"]
#: What entities have beside that: the key they are known by, and their spellings in order of first occurrence.
ENTITY = [*NODE, "canonical_key", "aliases"]


def mention_nodes(chunks: DataFrame) -> DataFrame:
    """Nodes of chunks (uri, doc_uri, title, workspace_id, acl_allow, entity_uris); a node's ACL is the union over all rows that bring it."""
    p = F.explode_outer("acl_allow").alias("p")
    docs = chunks.select(F.col("doc_uri").alias("uri"), F.lit("Document").alias("type"), F.col("title").alias("name"), "workspace_id", p).distinct()
    own = chunks.select("uri", F.lit("Chunk").alias("type"), F.col("uri").alias("name"), "workspace_id", p)
    # principals are made different before the shuffle (by hash: there are no strings to aggregate), so an entity that all chunks mention gathers but these
    ents = chunks.select(F.explode("entity_uris").alias("uri"), "workspace_id", "acl_allow").select("uri", "workspace_id", p).distinct()
    named = ents.select("uri", F.lit("Entity").alias("type"), entities.display_name(F.col("uri")).alias("name"), "workspace_id", "p")
    acl = F.array_sort(F.collect_set("p")).alias("acl_allow")
    return docs.unionByName(own).unionByName(named).groupBy("uri", "workspace_id").agg(F.min("type").alias("type"), F.min("name").alias("name"), acl).select(*NODE)


def mention_edges(chunks: DataFrame) -> DataFrame:
    """Different edges document -> chunk, chunk -> entity, entity -> document.

    Chunks meet by their own name and by their document's, not edge by edge: what is shuffled and made different are the arrays of chunks and documents, and
    edges are written out of them last.
    """
    contains = chunks.select(F.col("doc_uri").alias("src"), F.lit("CONTAINS").alias("rel"), F.col("uri").alias("dst"), "workspace_id").distinct()

    def each(key: str) -> DataFrame:
        own = chunks.groupBy(key, "workspace_id").agg(F.flatten(F.collect_set("entity_uris")).alias("e"))
        return own.select(key, "workspace_id", F.explode(F.array_distinct("e")).alias("e"))

    mentions = each("uri").select(F.col("uri").alias("src"), F.lit("MENTIONS").alias("rel"), F.col("e").alias("dst"), "workspace_id")
    documented = each("doc_uri").select(F.col("e").alias("src"), F.lit("DOCUMENTED_IN").alias("rel"), F.col("doc_uri").alias("dst"), "workspace_id")
    return contains.unionByName(mentions).unionByName(documented)


def relation_edges(relations: DataFrame) -> DataFrame:
    """Edges of (src, rel, dst, workspace_id) of known kinds with both ends."""
    ok = F.col("rel").isin(RELATIONS) & (F.trim(F.coalesce("src", F.lit(""))) != "") & (F.trim(F.coalesce("dst", F.lit(""))) != "")
    return relations.where(ok).select("src", "rel", "dst", "workspace_id").distinct()


def relation_ends(relations: DataFrame) -> DataFrame:
    """(uri, workspace_id, acl_allow) of the ends of those relations (src, rel, dst, workspace_id, acl_allow) that may be edges; principals of all that state one."""
    kept = relation_edges(relations).join(relations.select("src", "rel", "dst", "workspace_id", "acl_allow"), ["src", "rel", "dst", "workspace_id"])
    ends = kept.select(F.col("src").alias("uri"), "workspace_id", "acl_allow").unionByName(kept.select(F.col("dst").alias("uri"), "workspace_id", "acl_allow"))
    return ends.select("uri", "workspace_id", F.explode("acl_allow").alias("p")).distinct().groupBy("uri", "workspace_id").agg(F.array_sort(F.collect_set("p")).alias("acl_allow"))


def relation_nodes(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes (NODE) with entities for those ends of relations (src, rel, dst, workspace_id, acl_allow) that there are none of yet."""
    fresh = relation_ends(relations).join(nodes.select("uri", "workspace_id"), ["uri", "workspace_id"], "left_anti")
    return nodes.select(*NODE).unionByName(fresh.select("uri", F.lit("Entity").alias("type"), entities.display_name(F.col("uri")).alias("name"), "workspace_id", "acl_allow"))


def memory_nodes(memory: DataFrame) -> DataFrame:
    """A node for each memory item; only its owner may see it."""
    return memory.select("uri", F.lit("Memory").alias("type"), F.col("type").alias("name"), "workspace_id", F.array("subject").alias("acl_allow")).dropDuplicates(["uri"])


def memory_edges(memory: DataFrame) -> DataFrame:
    """Edges of memory items to the entities that they refer to."""
    return memory.select(F.col("uri").alias("src"), F.lit("MEMORY_REFERS_TO").alias("rel"), F.explode("entity_uris").alias("dst"), "workspace_id").distinct()


def visible(nodes: DataFrame, workspace_id: str, who: Column, enforce: bool = True) -> DataFrame:
    keep = F.col("workspace_id") == workspace_id
    return nodes.where(keep & access.readable(F.col("acl_allow"), who) if enforce else keep)


def followed(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges of the kinds that are asked for and may be followed (all of these if none is)."""
    return edges.where(F.col("rel").isin([k for k in kinds or [] if k in FOLLOWED] or FOLLOWED))


def visible_edges(edges: DataFrame, nodes: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges of followed kinds with both ends among the nodes."""
    ends = nodes.select("uri")
    return followed(edges, kinds).join(ends.withColumnRenamed("uri", "src"), "src", "left_semi").join(ends.withColumnRenamed("uri", "dst"), "dst", "left_semi").select("src", "rel", "dst")


def expand(edges: DataFrame, seeds: DataFrame, depth: int, max_nodes: int = 200, nodes: DataFrame | None = None) -> DataFrame:
    """(qid, uri, hop) reached from seeds (qid, uri) in up to `depth` undirected steps, nearest first (then by uri), at most max_nodes for each qid.

    nodes: those (uri) between which edges count, if not all do; `edges` is then a table that each step reads for what touches its nodes, and nothing of it is
    written or moved. Otherwise edges are written once in both directions. What each step finds is written: a step reads the last one's rows, so plans don't
    grow with the depth. A step keeps no more nodes of a qid than max_nodes has left; as nearer nodes come first, nothing behind a full step could be in the
    result. Nor could a node's neighbour behind its first max_nodes by uri: those before it are seen or come first.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if nodes is None:
        both = session.written(both.distinct(), "edges")
    place = F.dense_rank().over(W.partitionBy("src").orderBy("dst"))
    front = session.written(_first(seeds.select("qid", "uri").distinct(), None, max_nodes).withColumn("hop", F.lit(0)), "front")
    seen = front
    for hop in range(1, min(depth, 4) + 1):
        at = front.select("uri") if nodes is None else front.select("uri").join(nodes.select("uri"), "uri", "left_semi")
        touched = both.join(session.sent(at.select(F.col("uri").alias("src"))), "src", "left_semi")
        if nodes is not None:
            touched = touched.join(nodes.select(F.col("uri").alias("dst")), "dst", "left_semi")
        near = touched.withColumn("_n", place).where(F.col("_n") <= max_nodes).select("src", "dst").distinct()
        step = front.select("qid", F.col("uri").alias("src")).join(near, "src").select("qid", F.col("dst").alias("uri")).distinct()
        fresh = step.join(seen.select("qid", "uri"), ["qid", "uri"], "left_anti")
        front = session.written(_first(fresh, seen, max_nodes).withColumn("hop", F.lit(hop)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _first(rows: DataFrame, seen: DataFrame | None, most: int) -> DataFrame:
    """The first rows (qid, uri) of each qid by uri, as many as `most` leaves beside those seen; tasks cut their own rows before any are gathered."""
    rank = F.row_number().over(W.partitionBy("qid").orderBy("uri"))
    rows = rows.withColumn("_n", rank).where(F.col("_n") <= most)
    if seen is not None:
        have = seen.groupBy("qid").agg(F.count(F.lit(1)).alias("_have"))
        rows = rows.join(have, "qid").where(F.col("_n") + F.col("_have") <= most)
    return rows.select("qid", "uri")


def expanded_edges(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """Edges between reached nodes, with their paths [src, rel, dst]."""
    a = reached.select("qid", F.col("uri").alias("src"))
    b = reached.select("qid", F.col("uri").alias("dst"))
    return edges.join(a, "src").join(b, ["qid", "dst"]).select("qid", "src", "rel", "dst", F.array("src", "rel", "dst").alias("path"))


def resolve(queries: DataFrame, nodes: DataFrame, most: int = 20) -> DataFrame:
    """(qid, uri) of entities one of whose name's words is a token of the query, or whose key or an alias holds a token; at most `most` by uri.

    A node without canonical_key has the end of its uri for it. Tokens of all queries run over an entity's strings at once; no pair is tried.
    """
    words = queries.select("qid", F.explode(text.query_tokens(F.col("query"))).alias("string")).distinct()
    ents = nodes.where("type = 'Entity'")
    key = F.coalesce(F.col("canonical_key"), F.lit("")) if "canonical_key" in nodes.columns else F.lit("")
    aliases = F.coalesce(F.col("aliases"), F.array().cast("array<string>")) if "aliases" in nodes.columns else F.array().cast("array<string>")
    held = F.lower(F.concat_ws("\n", F.when(key != "", key).otherwise(F.regexp_replace("uri", "^.*kb://entity/", "")), aliases))
    inside = match.contained(words.select("string"), ents.select("uri", held.alias("text")), ["uri"])
    whole = ents.select("uri", F.explode(F.array_distinct(F.split(F.lower("name"), r"\s+"))).alias("string"))
    # of each token's entities no more than the first can be among the first of a query
    place = F.dense_rank().over(W.partitionBy("string").orderBy("uri"))
    first = inside.unionByName(whole.join(session.sent(words.select("string")), "string", "left_semi").select("uri", "string")).withColumn("_n", place).where(F.col("_n") <= most)
    hits = first.join(words, "string").select("qid", "uri").distinct()
    return hits.withColumn("_n", F.row_number().over(W.partitionBy("qid").orderBy("uri"))).where(F.col("_n") <= most).drop("_n")


def explain(edges: DataFrame, uris: DataFrame, most: int = 20) -> DataFrame:
    """(uri, reasons): that it came by similarity, then its edges in both directions by (rel, other end), at most `most`."""
    out = edges.select(F.col("src").alias("uri"), "rel", F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("uri"), "rel", F.col("src").alias("other")))
    mine = out.join(uris.select("uri").distinct(), "uri", "left_semi")
    # equal edges have one rank, so they need not be made different before the first ones are cut out
    top = mine.withColumn("_n", F.dense_rank().over(W.partitionBy("uri").orderBy("rel", "other"))).where(F.col("_n") <= most).distinct()
    lists = top.groupBy("uri").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.concat_ws(" ", "rel", "other").alias("r")))), lambda x: x["r"]).alias("graph"))
    return uris.select("uri").distinct().join(lists, "uri", "left").select("uri", F.concat(F.array(F.lit("vector")), F.coalesce("graph", F.array().cast("array<string>"))).alias("reasons"))


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame, workspace_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the given uris of a workspace."""
    dead = nodes.where(F.col("workspace_id") == workspace_id).join(gone.select("uri").distinct(), "uri", "left_semi").select("uri", "workspace_id")
    left = nodes.join(dead, ["uri", "workspace_id"], "left_anti")
    ends = edges.join(dead.withColumnRenamed("uri", "src"), ["src", "workspace_id"], "left_anti").join(dead.withColumnRenamed("uri", "dst"), ["dst", "workspace_id"], "left_anti")
    return left, ends
