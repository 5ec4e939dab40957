"""Knowledge graph: merging triples, entity index and boosts, multi-hop ranking of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.prompts import path_lines

#: Allowed entity types.
ENTITY_TYPES = ("Organization", "Person", "Subsidiary", "Event", "ESGAction", "GovernanceChange", "MedicalRecord", "Patient", "Location", "Time")
#: Canonical relations.
RELATIONS = ("founded", "located", "subsidiary", "acquisition", "invested", "financials", "dividend", "incident", "ESG", "management_change", "governance_change", "medical")
MAX_HOPS, DECAY = 2, 0.5


def document_text(text: Column, content: Column, body: Column) -> Column:
    """The first field that is not blank, as it is."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in (text, content, body)])


def usable(triples: DataFrame) -> DataFrame:
    """Triples (doc_id, pos, head, head_type, relation, tail, tail_type) with both ends; types default to Unknown."""
    t = triples.where((F.coalesce("head", F.lit("")) != "") & (F.coalesce("tail", F.lit("")) != ""))
    return t.withColumns({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in ("head_type", "tail_type")})


def complete(triples: Column, doc_id: Column) -> Column:
    """Triples of a document with its id where they have none."""
    return F.transform(triples, lambda t: t.withField("doc_id", F.coalesce(t["doc_id"], doc_id)))


def numbered(rows: DataFrame, order: list[str], name: str, bucket: str) -> DataFrame:
    """Row numbers from 0 over the whole order, without one task that holds all rows.

    bucket ascends with the order. Rows are numbered within their bucket; offsets come from prefix
    sums of bucket sizes, by groups of 4,096 buckets and then over the groups.
    """
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("_n")).withColumn("_g", F.floor(F.col(bucket) / 4096))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("_g").agg(F.sum("_n").alias("_n")).withColumn("_group", earlier(Window.orderBy("_g"))).drop("_n")
    within = sizes.withColumn("_bucket", earlier(Window.partitionBy("_g").orderBy(bucket)))
    offsets = within.join(groups, "_g").select(bucket, (F.col("_group") + F.col("_bucket")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(bucket).orderBy(*order)) - 1
    return rows.join(offsets, bucket).withColumn(name, (own + F.col("_before")).cast("long")).drop("_before")


def entities(triples: DataFrame) -> DataFrame:
    """(id, type, name, first): an id e1, e2, ... for each (type, name) by first appearance, head before tail.

    pos is the triple's place in the whole input.
    """
    t = usable(triples)
    ends = t.select(F.col("head_type").alias("type"), F.col("head").alias("name"), (F.col("pos") * 2).alias("at")).unionByName(t.select(F.col("tail_type").alias("type"), F.col("tail").alias("name"), (F.col("pos") * 2 + 1).alias("at")))
    first = ends.groupBy("type", "name").agg(F.min("at").alias("first")).withColumn("bucket", F.floor(F.col("first") / 4096))
    return numbered(first, ["first"], "n", "bucket").select(F.concat(F.lit("e"), (F.col("n") + 1).cast("string")).alias("id"), "type", "name", "first")


def with_ids(triples: DataFrame, ents: DataFrame) -> DataFrame:
    """Triples with head_id and tail_id."""
    e = ents.select("id", "type", "name")
    head = e.select(F.col("id").alias("head_id"), F.col("type").alias("head_type"), F.col("name").alias("head"))
    tail = e.select(F.col("id").alias("tail_id"), F.col("type").alias("tail_type"), F.col("name").alias("tail"))
    return usable(triples).join(head, ["head_type", "head"]).join(tail, ["tail_type", "tail"])


def relations(triples: DataFrame) -> DataFrame:
    return usable(triples).groupBy("relation").agg(F.count("*").alias("count"), F.min_by("head_type", "pos").alias("example_head_type"), F.min_by("tail_type", "pos").alias("example_tail_type"))


def doc_ranges(triples: DataFrame) -> DataFrame:
    """First and last index of each document's usable triples, counted over all."""
    t = usable(triples).withColumn("bucket", F.floor(F.col("pos") / 4096))
    return numbered(t, ["pos"], "i", "bucket").groupBy("doc_id").agg(F.min("i").alias("start_triple_index"), F.max("i").alias("end_triple_index"))


def statistics(triples: DataFrame, ents: DataFrame) -> DataFrame:
    t = usable(triples).agg(F.count("*").alias("total_triples"), F.countDistinct("relation").alias("total_relation_types"))
    return ents.agg(F.count("*").alias("total_entities")).join(t, how="cross")


def entity_index(triples: DataFrame) -> DataFrame:
    """(entity, doc_id): lower-cased heads and tails with the documents they are in."""
    return triples.select(F.explode(F.array(F.lower("head"), F.lower("tail"))).alias("entity"), F.col("doc_id").cast("string").alias("doc_id")).where("entity is not null and entity <> ''").distinct()


def entity_boosts(query_tokens: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, doc_id, boost): matches of token occurrences, over the most of any document."""
    hits = query_tokens.join(index, query_tokens["token"] == index["entity"]).groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    return hits.withColumn("boost", F.col("n") / F.max("n").over(Window.partitionBy("query_id"))).drop("n")


def entities_in_query(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, entity) of entities whose whole name stands in the query, by its word n-grams."""
    from lodestone.functions import text as T

    names = index.select("entity").distinct()
    longest = names.agg(F.max(F.size(F.split("entity", r"\s+")))).first()[0] or 1
    grams = queries.select("query_id", F.explode(T.ngrams(F.split(F.lower("text"), r"\s+"), longest)).alias("entity"))
    return grams.join(names, "entity")


def hops(seeds: DataFrame, triples: DataFrame, most: int = MAX_HOPS) -> DataFrame:
    """(query_id, entity, hop): entities reached from (query_id, entity), either way, at their least hop."""
    t = triples.select(F.lower("head").alias("a"), F.lower("tail").alias("b"))
    edges = t.unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = seeds.select("query_id", "entity").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for i in range(1, most + 1):
        reached = frontier.join(edges, frontier["entity"] == edges["a"]).select("query_id", F.col("b").alias("entity")).distinct()
        frontier = reached.join(seen, ["query_id", "entity"], "left_anti").withColumn("hop", F.lit(i))
        seen = seen.unionByName(frontier)
    return seen


def rank_docs(seeds: DataFrame, triples: DataFrame, k: int = 50, most: int = MAX_HOPS, decay: float = DECAY) -> DataFrame:
    """(query_id, doc_id, score, rank): sum of decay^hop over reached entities of a document, over the query's best."""
    from .score import ranked

    found = hops(seeds, triples, most).join(entity_index(triples), "entity").groupBy("query_id", "doc_id").agg(F.sum(F.pow(F.lit(decay), F.col("hop"))).alias("raw"))
    scored = found.withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy("query_id"))).drop("raw")
    return ranked(scored, k)


def health(triples: DataFrame) -> DataFrame:
    """Counts that tell whether a graph can be used."""
    return triples.agg(F.count("*").alias("triples"), F.count_if(F.coalesce("head", F.lit("")) == "").alias("no_head"), F.count_if(F.coalesce("tail", F.lit("")) == "").alias("no_tail"), F.count_if(F.col("doc_id").isNull()).alias("no_doc"))


def checked(triples: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """Triples with `problem`: no_end, entity_type, relation, or null where they keep the schema."""
    end = (F.coalesce("head", F.lit("")) == "") | (F.coalesce("tail", F.lit("")) == "")
    kind = ~F.coalesce(F.col("head_type").isin(*ENTITY_TYPES), F.lit(False)) | ~F.coalesce(F.col("tail_type").isin(*ENTITY_TYPES), F.lit(False))
    return triples.withColumn("problem", F.when(end, "no_end").when(kind, "entity_type").when(~F.coalesce(F.col("relation").isin(*relations), F.lit(False)), "relation"))


def with_defaults(triples: DataFrame, docs: DataFrame) -> DataFrame:
    """Triples whose missing domain and language are those of their document (doc_id, domain, language)."""
    about = docs.select("doc_id", F.col("domain").alias("_domain"), F.col("language").alias("_language"))
    rows = triples.join(about, "doc_id", "left")
    return rows.withColumns({"domain": F.coalesce("domain", "_domain"), "language": F.coalesce("language", "_language")}).drop("_domain", "_language")


def domains(triples: DataFrame) -> DataFrame:
    """(doc_id, domain): the domain of each document's first triple that has one."""
    return triples.where("domain is not null").groupBy("doc_id").agg(F.min_by("domain", "pos").alias("domain"))


def paths(seeds: DataFrame, triples: DataFrame, most: int = MAX_HOPS) -> DataFrame:
    """(query_id, entity, hop, path): as hops(), with the steps of a shortest way, the first by text."""
    t = triples.select(F.lower("head").alias("a"), F.lower("tail").alias("b"), path_lines(F.col("head"), F.col("relation"), F.col("tail")).alias("step"))
    edges = t.unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"), "step")).groupBy("a", "b").agg(F.min("step").alias("step"))
    seen = seeds.select("query_id", "entity").distinct().withColumns({"hop": F.lit(0), "path": F.lit("")})
    frontier = seen
    for i in range(1, most + 1):
        way = F.concat_ws(" ; ", F.when(F.col("path") != "", F.col("path")), "step")
        reached = frontier.join(edges, frontier["entity"] == edges["a"]).groupBy("query_id", F.col("b").alias("entity")).agg(F.min(way).alias("path"))
        frontier = reached.join(seen.select("query_id", "entity"), ["query_id", "entity"], "left_anti").select("query_id", "entity", F.lit(i).alias("hop"), "path")
        seen = seen.unionByName(frontier)
    return seen


def evidence(ranked_docs: DataFrame, reached: DataFrame, triples: DataFrame, docs: int = 5, each: int = 3) -> DataFrame:
    """(query_id, doc_id, rank, score, paths, evidence_triples) of each query's first `docs` documents: up
    to `each` paths to their entities and up to `each` of their triples that touch a reached entity, by hop,
    then text. `reached` is that of paths()."""
    top = ranked_docs.where(F.col("rank") <= docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    t = triples.select(F.col("doc_id").cast("string").alias("doc_id"), F.lower("head").alias("_h"), F.lower("tail").alias("_t"), path_lines(F.col("head"), F.col("relation"), F.col("tail")).alias("_line"))
    ends = t.select("doc_id", "_line", F.explode(F.array("_h", "_t")).alias("entity"))
    rows = top.select("query_id", "doc_id").join(ends, "doc_id").join(reached, ["query_id", "entity"])
    lines = rows.groupBy("query_id", "doc_id", F.col("_line").alias("line")).agg(F.min("hop").alias("hop")).withColumn("kind", F.lit("triple"))
    ways = rows.where("path <> ''").groupBy("query_id", "doc_id", F.col("path").alias("line")).agg(F.min("hop").alias("hop")).withColumn("kind", F.lit("path"))
    order = Window.partitionBy("query_id", "doc_id", "kind").orderBy("hop", "line")
    best = lines.unionByName(ways).withColumn("n", F.row_number().over(order)).where(F.col("n") <= each)
    of = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", "line")))), lambda x: x["line"])
    found = best.groupBy("query_id", "doc_id").agg(of("path").alias("paths"), of("triple").alias("evidence_triples"))
    none = F.array().cast("array<string>")
    return top.join(found, ["query_id", "doc_id"], "left").withColumns({c: F.coalesce(c, none) for c in ("paths", "evidence_triples")})


def entity_info(seeds: DataFrame, triples: DataFrame, most: int = MAX_HOPS) -> DataFrame:
    """(query_id, entities_found, related_doc_ids, multi_hop_entities, max_hops): counts and lists, sorted."""
    reached = hops(seeds, triples, most)
    index = entity_index(triples)
    docs = seeds.join(index, "entity").groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("related_doc_ids"))
    found = seeds.join(index.select("entity").distinct(), "entity", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_set("entity")).alias("entities_found"))
    far = reached.groupBy("query_id").agg(F.count_if(F.col("hop") > 0).alias("multi_hop_entities"), F.max("hop").alias("max_hops"))
    none = F.array().cast("array<string>")
    out = far.join(found, "query_id", "left").join(docs, "query_id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("entities_found", "related_doc_ids")})
