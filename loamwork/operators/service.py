"""Whole calls: a search for a caller, ingestion of files, and the statuses and records that calls leave."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from dataclasses import fields as dataclass_fields

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamwork import session
from loamwork.functions import access, text
from loamwork.operators import embedding, entities, extract, graph, ingest, lexindex, memory, retrieve, route, vecindex, vector
from loamwork.operators.filters import Filter


@dataclass(frozen=True)
class Vectors:
    """A vector index of chunks that carries the columns of Filter, and the model that made its vectors and embeds queries. probes: cells that a query
    visits (None: all, exact)."""

    index: vecindex.Index
    model: embedding.Embedder
    preset: str = "all-MiniLM-L6-v2"
    probes: int | None = None

    @classmethod
    def of(cls, chunks: DataFrame, model: embedding.Embedder, preset: str = "all-MiniLM-L6-v2", probes: int | None = None) -> Vectors:
        made = embedding.embed_column(chunks.select("uri", "text", *Filter.COLUMNS), "text", model, "vec", preset)
        return cls(vecindex.build(made.drop("text"), list(Filter.COLUMNS)), model, preset, probes)

    def find(self, queries: DataFrame, k: int, keep: Column) -> DataFrame:
        asked = embedding.embed_column(queries.select("qid", "query"), "query", self.model, "vec", self.preset, passage=False)
        return vecindex.search(asked.select("qid", "vec"), self.index, k, keep, self.probes).select("qid", "uri", "score")


@dataclass(frozen=True)
class KnowledgeBase:
    """Tables that a search reads. chunks: uri, doc_uri, text, span, entity_uris and the columns of Filter; nodes may have canonical_key and aliases.

    index: an inverted index of the chunks that carries the columns of Filter; searches that have none make one of what the caller may see.
    vectors: a vector index of the chunks, which then finds the hits instead of tokens.
    """

    docs: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    memory: DataFrame
    index: lexindex.Index | None = None
    vectors: Vectors | None = None


def search(requests: DataFrame, kb: KnowledgeBase, caller: Filter, fusion: str = "linear", top_k: int = retrieve.TOP_K, top_n: int = retrieve.TOP_N, depth: int = 1, max_nodes: int = 200, kinds: list[str] | None = None, enforce: bool = True, expand: bool = False, reranker: retrieve.Reranker | None = None, fallback: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, memory hits, traces) of a caller's requests (qid, query, mode, include_memory).

    The caller's filter cuts chunks before they are searched; memory is the caller's own; the graph is walked over what the caller may see, from entities that the
    query names, unless the mode is vector. Results carry evidence with masked snippets. If the graph can't be read, similarity and memory alone give the results,
    and traces have fallback_mode and fallback_reason; without `fallback` the call fails, so that nothing of it looks like a search of a graph that has nothing.
    """
    who = access.principals(F.lit(caller.subject), F.array(*map(F.lit, caller.roles)).cast("array<string>"))
    allowed = caller.apply(kb.chunks)
    routed = requests.withColumn("intent", route.intent(F.col("query"), F.col("include_memory"))).withColumn("reason", route.reason(F.col("query"), F.col("mode")))
    owner = requests.where("include_memory").withColumns({"workspace_id": F.lit(caller.workspace_id), "subject": F.lit(caller.subject)})
    remembered = session.written(memory.search(owner, kb.memory, min(5, top_k)), "remembered")
    bonus = memory.chunk_bonus(remembered, kb.memory)
    nodes = graph.visible(kb.nodes, caller.workspace_id, who, enforce)
    failure = None
    try:
        seeds = session.written(graph.resolve(requests.where("mode <> 'vector'"), nodes), "seeds")
        own = kb.edges.where(F.col("workspace_id") == caller.workspace_id) if "workspace_id" in kb.edges.columns else kb.edges
        reached = graph.expand(graph.followed(own, kinds), seeds, retrieve.depth_of("hybrid", depth), max_nodes, nodes)
    except PySparkException as error:  # the graph's tables can't be read or are not what they should be: similarity alone, and why
        if not fallback:
            raise
        failure = str(error)
        seeds = reached = requests.sparkSession.createDataFrame([], requests.select("qid", F.col("query").alias("uri")).schema)
    expanded = retrieve.expand_queries(requests, retrieve.entity_hits(requests, nodes.where("type = 'Entity'"))) if expand else None
    find = None if kb.index is None else lambda q, k: vector.indexed(q, kb.index, k, caller.condition())
    if kb.vectors is not None:
        find = lambda q, k: kb.vectors.find(q, k, caller.condition())
    found = retrieve.search(requests.select("qid", "query"), allowed, reached.select("qid", "uri"), bonus, fusion, min(top_k, retrieve.MOST_K), top_n, expanded=expanded, find=find, reranker=reranker)
    # written: results and traces read them, and they are few beside the chunks, which then stay where they lie
    found = session.written(found, "found")
    results = retrieve.evidence(found, allowed.join(session.sent(found.select("uri")), "uri", "left_semi"), kb.docs)
    hits = remembered.join(kb.memory.select("uri", text.redact(F.col("text")).alias("text"), "citations"), "uri")
    per = lambda df, name: df.groupBy("qid").agg(F.count(F.lit(1)).alias(name))
    lit = found.groupBy("qid").agg(F.bool_or(F.col("graph") > 0).alias("graph_nonzero"), F.count_if(F.col("graph") > 0).alias("graph_bonus"))
    traces = routed.select("qid", "mode", "intent", "reason").join(per(seeds, "seeds"), "qid", "left").join(per(reached, "reached"), "qid", "left").join(lit, "qid", "left")
    fallback = {"fallback_mode": F.lit(None if failure is None else "vector").cast("string"), "fallback_reason": F.lit(failure).cast("string")}
    return results, hits, traces.fillna(0, ["seeds", "reached", "graph_bonus"]).fillna(False, ["graph_nonzero"]).withColumns(fallback)


@dataclass(frozen=True)
class Store:
    """Tables that ingestion changes: docs, chunks, nodes, edges, the ledger (workspace_id, source_path, checksum) and, if they are kept, the relations that
    each chunk states (uri, src, rel, dst, workspace_id). Nodes of entities have canonical_key and aliases; where a store has none, they begin empty.

    scratch: tables that were written on the way and that the others are plans over, until these are written themselves."""

    docs: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    ledger: DataFrame
    stated: DataFrame | None = None
    scratch: tuple[DataFrame, ...] = ()

    def written(self, *names: str) -> Store:
        """The same as written tables, as a store is kept between ingestions; names: only these, and the others stay plans."""
        names = names or tuple(f.name for f in dataclass_fields(self) if f.name != "scratch")
        return replace(self, **{n: session.written(df, f"store-{n}") for n in names if (df := getattr(self, n)) is not None})

    def knowledge_base(self, memory: DataFrame, index: lexindex.Index | None = None) -> KnowledgeBase:
        """What a search reads, with an index of all chunks (made unless it is given)."""
        index = index or vector.index(self.chunks, list(Filter.COLUMNS))
        return KnowledgeBase(self.docs, self.chunks, self.nodes, self.edges, memory, index)


def empty_store(spark: SparkSession) -> Store:
    """A store before its first ingestion."""
    own = "workspace_id string, title string, source string, source_path string, acl_allow array<string>, tags array<string>, updated_at timestamp"
    of = lambda schema: spark.createDataFrame([], schema)
    return Store(
        of(f"doc_uri string, doc_key string, {own}"),
        of(f"uri string, doc_uri string, {own}, chunk_idx int, text string, span struct<start:int,end:int>, entity_uris array<string>"),
        of("uri string, type string, name string, workspace_id string, acl_allow array<string>, canonical_key string, aliases array<string>"),
        of("src string, rel string, dst string, workspace_id string"),
        of("workspace_id string, source_path string, checksum string"),
        of("uri string, src string, rel string, dst string, workspace_id string"),
    )


def ingest_files(files: DataFrame, store: Store, spans: Callable[[DataFrame], DataFrame], only: DataFrame | None = None, extraction: entities.Extraction = entities.Extraction()) -> tuple[Store, DataFrame]:
    """(store, counters) after files (workspace_id, source_path, title, source, tags, acl_allow, updated_at, text); only: the changed paths (source_path).

    New and changed files become documents, chunks, entities with their spellings, edges and relations. Their chunks and edges take the place of what these files
    had before, whether a chunk is gone or has another text; so do relations, where the store keeps what each chunk states (a relation that other chunks
    state as well stays), else relations stay. Entities stay when nothing mentions them any more. A principal who could read a node before still can: lists
    of principals are joined. Unchanged and blank files are skipped.
    """
    files = files if only is None else files.join(only.select("source_path").distinct(), "source_path", "left_semi")
    judged = ingest.changes(files, store.ledger)
    fresh = ingest.doc_identity(judged.where("status <> 'skipped'"), store.docs.select("doc_key", "workspace_id"))
    docs = fresh.withColumn("doc_uri", F.concat(F.lit("kb://doc/"), "doc_key"))
    cut = spans(docs).select("*", F.posexplode("spans").alias("chunk_idx", "span"))
    made = cut.withColumn("uri", F.concat(F.lit("kb://chunk/"), "doc_key", F.lit("_"), F.col("chunk_idx").cast("string"))).withColumn("text", text.span_text(F.col("text"), F.col("span")))
    made = session.written(made.withColumn("entity_uris", entities.named_uris(F.col("text"), extraction)), "made-chunks")
    before = store.chunks.join(docs.select("doc_uri"), "doc_uri", "left_semi")
    gone = ingest.stale(before, made)
    chunks = ingest.upsert(store.chunks.join(gone, "uri", "left_anti"), made.select(*store.chunks.columns), ["uri"])

    stated = session.written(extract.relations_of(made, extraction=extraction, carry=["uri", "workspace_id", "acl_allow"]).select("uri", "workspace_id", "acl_allow", "src", "rel", "dst"), "stated")
    dead = before.select("uri", "workspace_id").join(gone, "uri", "left_semi")
    kept = store.nodes.join(dead, ["uri", "workspace_id"], "left_anti")
    edges = _without(store.edges, before.select("uri", "workspace_id").unionByName(made.select("uri", "workspace_id")), dead, docs)
    relation = ["src", "rel", "dst", "workspace_id"]
    said = None
    if store.stated is not None:
        others = store.stated.join(before.select("uri", "workspace_id"), ["uri", "workspace_id"], "left_anti")
        said = others.unionByName(stated.select("uri", *relation))
        lost = store.stated.join(before.select("uri", "workspace_id"), ["uri", "workspace_id"], "left_semi").select(*relation).distinct().join(said.select(*relation).distinct(), relation, "left_anti")
        edges = edges.join(lost, relation, "left_anti")
    # old edges of other kinds end or begin at nothing that is made anew, so but relations can be there twice
    related = F.col("rel").isin(graph.RELATIONS)
    again = edges.where(related).select(*relation).unionByName(graph.relation_edges(stated)).distinct()
    edges = edges.where(~related).select(*relation).unionByName(again).unionByName(graph.mention_edges(made))
    spelled = graph.mention_nodes(made).join(entities.aliases(made, extraction), ["uri", "workspace_id"], "left")
    named = spelled.select("uri", "type", F.coalesce(F.get("aliases", F.lit(0)), F.col("name")).alias("name"), "workspace_id", "acl_allow", F.when(F.col("type") == "Entity", entities.canonical_key(F.col("uri"))).alias("canonical_key"), "aliases")
    nodes = merged_nodes(kept, named, stated)
    ledger = ingest.upsert(store.ledger, docs.select("workspace_id", "source_path", "checksum"), ["workspace_id", "source_path"])
    after = Store(ingest.upsert(store.docs, docs.select(*store.docs.columns), ["doc_uri"]), chunks, nodes, edges, ledger, said, (made, stated))
    return after, ingest.counters(judged)


def _without(edges: DataFrame, chunks: DataFrame, dead: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges but those that chunks and documents made anew had (each kind is met at its end that is no entity, so that no entity of many edges is a join key),
    and those of dead chunks."""
    ends = chunks.select(F.col("uri").alias("_end"), "workspace_id").unionByName(docs.select(F.col("doc_uri").alias("_end"), "workspace_id")).distinct()
    less = lambda rows, gone, side: rows.join(gone.withColumnRenamed("_end", side), [side, "workspace_id"], "left_anti")
    rel = F.col("rel")
    out = less(edges.where(rel.isin("CONTAINS", "MENTIONS")), ends, "src").unionByName(less(edges.where(rel == "DOCUMENTED_IN"), ends, "dst"))
    lost = dead.withColumnRenamed("uri", "_end")
    rest = edges.where(~rel.isin("CONTAINS", "MENTIONS", "DOCUMENTED_IN", *graph.RELATIONS))
    return out.unionByName(edges.where(rel.isin(graph.RELATIONS))).unionByName(less(less(rest, lost, "src"), lost, "dst"))


def _entity_columns(nodes: DataFrame) -> DataFrame:
    """Nodes with all columns of entities; those that a table has not are null."""
    lacks = {"canonical_key": "string", "aliases": "array<string>"}
    return nodes.withColumns({c: F.lit(None).cast(kind) for c, kind in lacks.items() if c not in nodes.columns}).select(*graph.ENTITY)


def merged_nodes(old: DataFrame, new: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """One node for each (uri, workspace): the old name and key, aliases of both (old ones first), and principals of both. stated: relations, whose ends become
    entities where there are none of yet."""
    rows = _entity_columns(old).withColumn("_n", F.lit(0)).unionByName(_entity_columns(new).withColumn("_n", F.lit(1)))
    if stated is not None:
        ends = graph.relation_ends(stated).withColumn("name", entities.display_name(F.col("uri")))
        own = ends.select("uri", F.lit("Entity").alias("type"), "name", "workspace_id", "acl_allow", entities.canonical_key(F.col("uri")).alias("canonical_key"), F.array("name").alias("aliases"))
        rows = rows.unionByName(own.withColumn("_n", F.lit(2)))
    # an end of a relation gives a node its principals and aliases only if nothing else is the node
    there = F.col("_n") < 2
    united = lambda test: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(test, F.col("acl_allow"))))))
    first = lambda c: F.min_by(c, F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.col("_n"))).alias(c)
    listed = lambda test: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(test & F.col("aliases").isNotNull(), F.struct("_n", "aliases")))), lambda x: x["aliases"])))
    alone = F.min("_n") == 2
    acl = F.when(alone, united(~there)).otherwise(united(there)).alias("acl_allow")
    names = F.when(F.min_by("type", "_n") == "Entity", F.filter(F.when(alone, listed(~there)).otherwise(listed(there)), lambda x: F.trim(x) != "")).alias("aliases")
    return rows.groupBy("uri", "workspace_id").agg(first("type"), first("name"), acl, first("canonical_key"), names).select(*graph.ENTITY)


def ingest_statuses(requests: DataFrame, running: DataFrame, roots: list[str]) -> DataFrame:
    """(request_id, status): PERMISSION_DENIED for roots that are not allowed; CONFLICT where the workspace is being ingested or an earlier request of it comes first; else OK."""
    allowed = requests.withColumn("_ok", access.path_allowed(F.col("root"), roots))
    first = F.row_number().over(W.partitionBy("workspace_id", "_ok").orderBy("at", "request_id")) == 1
    held = running.select("workspace_id", F.lit(True).alias("_held")).distinct()
    rows = allowed.withColumn("_first", first).join(held, "workspace_id", "left")
    status = F.when(~F.col("_ok"), "PERMISSION_DENIED").when(F.coalesce("_held", F.lit(False)) | ~F.col("_first"), "CONFLICT").otherwise("OK")
    return rows.select("request_id", status.alias("status"))


def cycle_summary(roots: DataFrame) -> DataFrame:
    """One row with the counters of a cycle over roots (status: ok, skipped or failed; method: git_diff or full; attempts; created; updated)."""
    ok = F.col("status") == "ok"
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c)
    return roots.agg(
        total("created"),
        total("updated"),
        F.count_if(ok).alias("processed_roots"),
        F.count_if(F.col("status") == "skipped").alias("skipped_roots"),
        F.count_if(F.col("status") == "failed").alias("failed_roots"),
        F.count_if(ok & (F.col("method") == "git_diff")).alias("git_diff_roots"),
        F.count_if(ok & (F.col("method") == "full")).alias("full_roots"),
        F.count_if(ok & (F.col("attempts") > 1)).alias("retried_roots"),
    )


def audit(calls: DataFrame, params: list[str], *facts: str) -> DataFrame:
    """Audit rows: the facts and the hash of the parameters as JSON with sorted keys."""
    return calls.select(*facts, F.sha2(F.to_json(F.struct(*sorted(params))), 256).alias("params_hash"))


def health(spark: SparkSession, parts: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(part, status, n, reason): whether each table can be read, and how many rows it has; the row `all` is ok, degraded (some can't) or error (none can)."""
    rows = []
    for part, table in parts.items():
        try:
            rows.append((part, "ok", table().count(), None))
        except PySparkException as error:
            rows.append((part, "error", None, str(error)[:300]))
    good = sum(r[1] == "ok" for r in rows)
    rows.append(("all", "ok" if good == len(parts) else "degraded" if good else "error", None, None))
    return spark.createDataFrame(rows, "part string, status string, n long, reason string")


AUDIT = "at timestamp, subject string, workspace_id string, tool string, params_hash string, result_count long, latency_ms long, auth_mode string, identity_source string, acl_decision string"


def append_audit(rows: DataFrame, path: str) -> None:
    """Adds audit rows to the log at `path`, in folders by day; what is there is never changed. Columns that rows have not are null."""
    wanted = [x.split() for x in AUDIT.split(", ")]
    own = rows.select(*(F.col(c).cast(kind).alias(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in wanted))
    own.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT + ", day date").parquet(path)


def contract(status: Column) -> Column:
    """ok, error_code, recoverable and next_action of a call's status."""
    # Codes of failures that another try may mend, and what to do then.
    mend = {"CONFLICT": "retry_later", "RATE_LIMITED": "retry_later", "CIRCUIT_OPEN": "retry_later"}
    ok = status == "OK"
    action = F.lit("none")
    for code, then in mend.items():
        action = F.when(status == code, then).otherwise(action)
    return F.struct(ok.alias("ok"), F.when(~ok, status).alias("error_code"), status.isin(list(mend)).alias("recoverable"), action.alias("next_action"))


__all__ = ["KnowledgeBase", "Store", "audit", "contract", "cycle_summary", "empty_store", "health", "ingest_files", "ingest_statuses", "search"]
