"""The evidence pipeline as tables: parse, extract, validate, resolve, gate, write, enrich, review, delete."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import records, text as T
from graphloom.operators.lineage import cut
from graphloom.operators.resolution import ACCEPTED, REVIEW, confidence_gate, scored_candidates, shared_identifier_pairs
from graphloom.schema import ENDPOINTS, MAX_FANOUT, RELATIONSHIPS
from graphloom.sinks import entity_store as store
from graphloom.sinks import graph_store

#: An extractor takes evidence(evidence_id, text) and returns mentions(evidence_id, local_id, type, name, confidence, props map).
Extractor = Callable[[DataFrame], DataFrame]

# Patterns and confidence of the rule extractor; what a merge and a suggestion need.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]"
PHONE = r"\+[0-9][0-9() -]{7,17}[0-9]"
MERGE, SUGGEST = 0.93, 0.75
# States of evidence under way.
ACTIVE = ("parsing", "parsed", "extracting", "extracted", "resolving", "resolved", "writing", "written", "enriching")


def ingest(incoming: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Evidence rows of incoming(source, text): stripped, not empty, one a content hash (the least source), new against known(sha256, status).

    Failed and cancelled evidence doesn't count as known.
    """
    t = incoming.withColumn("text", F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))).where(F.length("text") > 0)
    t = t.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256))
    one = t.groupBy("sha256").agg(F.min("source").alias("source"), F.first("text").alias("text"))
    if known is not None:
        one = one.join(known.where(~F.col("status").isin("failed", "cancelled")).select("sha256"), "sha256", "left_anti")
    return one.select(F.substring("sha256", 1, 32).alias("evidence_id"), "source", "sha256", "text", F.lit("uploaded").alias("status"))


def rule_extractor(evidence: DataFrame) -> DataFrame:
    """E-mail addresses and phone numbers of whole texts; stands in where no model can be called."""
    def found(pattern: str, kind: str, key: str) -> DataFrame:
        each = evidence.select("evidence_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("name"))
        return each.select("evidence_id", F.lit(kind).alias("type"), "name", F.create_map(F.lit(key), F.col("name")).alias("props"))

    every = found(EMAIL, "Email", "address").unionByName(found(PHONE, "Phone", "number"))
    return every.select("evidence_id", F.concat_ws(":", F.lower("type"), "name").alias("local_id"), "type", "name", F.lit(0.9).alias("confidence"), "props")


def extracted(evidence: DataFrame, extractor: Extractor = rule_extractor) -> DataFrame:
    """Mentions in order: malformed rows (no name, unknown confidence) go one by one, the first of a type and name in an evidence stays."""
    m = extractor(evidence).where((F.trim("name") != "") & F.col("confidence").between(0, 1))
    best = m.groupBy("evidence_id", "type", "name").agg(F.min_by(F.struct("local_id", "confidence", "props"), "local_id").alias("_m"))
    return best.select("evidence_id", "type", "name", "_m.*")


def merged_chunks(mentions: DataFrame, relations: DataFrame, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The extractions of a text's chunks as one: (mentions, relations, answers).

    mentions(evidence_id, chunk, local_id, type, name, ...): of a type and name the first
    chunk's stays, and relations(evidence_id, chunk, source, target, ...) of the others lead
    to it. answers(evidence_id, chunk, summary, overall_confidence): the first summary that
    isn't empty, the greatest confidence. Local ids get their chunk, so equal ones differ.
    """
    own = lambda c: F.concat_ws(":", "chunk", c)
    m = mentions.withColumn("local_id", own("local_id"))
    first = m.groupBy("evidence_id", "type", "name").agg(F.min_by("local_id", F.struct("chunk", "local_id")).alias("_first"))
    led = m.join(first, ["evidence_id", "type", "name"])
    kept = led.where("local_id = _first").drop("_first", "chunk").dropDuplicates(["evidence_id", "local_id"])
    to = led.select("evidence_id", F.col("local_id").alias("_id"), "_first").distinct()
    r = relations
    for end in ("source", "target"):
        r = r.withColumn("_id", own(end)).join(to, ["evidence_id", "_id"]).withColumn(end, F.col("_first")).drop("_id", "_first")
    if answers is None:
        return kept, r.drop("chunk"), None
    said = F.when(F.trim("summary") != "", F.col("summary"))
    a = answers.groupBy("evidence_id").agg(F.min_by(said, F.when(said.isNotNull(), F.col("chunk"))).alias("summary"), F.max("overall_confidence").alias("overall_confidence"))
    return kept, r.drop("chunk"), a


def put(m: Column, values: dict[str, Column]) -> Column:
    """A map with values set; null ones aren't."""
    new = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
    m = F.coalesce(m, F.expr("map()").cast("map<string,string>"))
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def normalized(mentions: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """Names and attributes in normal form with their certain key; phones and e-mails that can't be read go.

    countries(alias, name, iso2), at most a few hundred rows (see functions.countries), names
    countries and their keys; without it they stay as they are, without a key.
    """
    kind, p, blanks = F.col("type"), F.col("props"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    m = mentions
    if countries is not None:
        known = F.broadcast(countries.select("alias", F.col("name").alias("_country"), F.col("iso2").alias("_iso2")))
        m = m.withColumn("_alias", F.when(kind == "Country", F.lower(F.trim("name")))).join(known, F.col("_alias") == F.col("alias"), "left").drop("_alias", "alias")
    else:
        m = m.withColumns({"_country": F.lit(None).cast("string"), "_iso2": F.lit(None).cast("string")})
    day = lambda k: F.when(p[k].isNotNull(), F.coalesce(records.date(p[k]), p[k]))
    number = T.normalize_identifier(F.coalesce(T.blank_to_null(p["number"]), F.col("name")))
    iban = F.upper(F.regexp_replace(F.coalesce(T.blank_to_null(p["iban"]), T.blank_to_null(p["account_number"]), F.col("name")), r"\s", ""))
    phone, email = (read(F.coalesce(T.blank_to_null(p[k]), F.col("name"))) for read, k in ((records.phone, "number"), (T.normalize_email, "address")))
    name = (
        F.when(kind == "Person", records.person_name(F.col("name"))).when(kind == "Email", email).when(kind == "Phone", phone).when(kind == "Document", number).when(kind == "BankAccount", iban)
        .when(kind == "Address", F.initcap(blanks(F.col("name")))).when(kind.isin("Company", "Organization"), blanks(F.col("name"))).when(kind == "Country", F.coalesce("_country", F.trim("name"))).otherwise(F.trim("name"))
    )
    props = (
        F.when(kind == "Person", put(p, {"dob": day("dob"), "national_id": T.normalize_identifier(p["national_id"])})).when(kind == "Email", put(p, {"address": email})).when(kind == "Phone", put(p, {"number": phone}))
        .when(kind == "Document", put(p, {"number": number, "document_type": F.lower(F.trim(F.coalesce(T.blank_to_null(p["document_type"]), F.lit("document")))), **{k: day(k) for k in ("issue_date", "expiry_date", "dob")}}))
        .when(kind == "BankAccount", put(p, {"iban": iban})).when(kind == "Country", put(p, {"iso2": F.col("_iso2")})).otherwise(p)
    )
    m = m.withColumn("_n", name).withColumn("props", props).drop("name").withColumnRenamed("_n", "name").where(F.col("name").isNotNull())
    given = {k: F.col("props")[k] for k in ("national_id", "document_type", "iban", "account_number", "plate", "registration", "address", "number", "iso2")}
    return m.drop("_country", "_iso2").withColumn("key", T.deterministic_key(kind, given))


def normalized_extraction(mentions: DataFrame, relations: DataFrame, countries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(normalised mentions, valid relations): what led to a mention that went, goes too."""
    m = normalized(mentions, countries)
    return m, valid_relationships(relations, m)


def relationship_type(raw: Column) -> Column:
    t = F.regexp_replace(F.upper(F.trim(raw)), " ", "_")
    return F.when(t.isin(*RELATIONSHIPS), t).otherwise("RELATED_TO")


def valid_relationships(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """relations(evidence_id, source, target, type, confidence) whose ends exist.

    Ends that the ontology doesn't allow for the type make it RELATED_TO, the old type kept as label.
    """
    ends = lambda side: mentions.select("evidence_id", F.col("local_id").alias(side), F.col("type").alias(f"{side}_type"))
    r = relations.withColumn("type", relationship_type(F.col("type"))).join(ends("source"), ["evidence_id", "source"]).join(ends("target"), ["evidence_id", "target"])
    allowed = F.lit(False)
    for kind, (left, right) in ENDPOINTS.items():
        allowed = allowed | ((F.col("type") == kind) & F.col("source_type").isin(*left) & F.col("target_type").isin(*right))
    allowed = allowed | (F.col("type") == "RELATED_TO")
    return r.withColumn("label", F.when(~allowed, F.col("type"))).withColumn("type", F.when(allowed, F.col("type")).otherwise("RELATED_TO"))


def resolve_keys(mentions: DataFrame) -> DataFrame:
    """Each mention's entity_id: mentions of one certain key, or of one type and name in lower case where there is none, are one entity.

    Equal whatever the order of arrival; the id is a hash of what identifies it, so no shuffle is needed.
    """
    same = F.coalesce("key", F.concat_ws(":", F.lit("name"), F.lower("type"), F.lower(F.regexp_replace(F.trim("name"), r"\s+", " "))))
    return mentions.withColumn("entity_id", F.substring(F.sha2(same.cast("binary"), 256), 1, 32))


def registry(mentions: DataFrame) -> DataFrame:
    """One row an entity: canonical name (the first evidence's), aliases, attributes, key, greatest confidence, evidence. Counts are pre-aggregated.

    Of an attribute's values the first stays. Which evidence supports an entity is a table of
    its own (support), so an entity that much evidence names is no long row.
    """
    order = F.struct("evidence_id", "local_id")
    m = mentions.withColumns({c: F.lit(None).cast(t) for c, t in {"props": "map<string,string>", "key": "string"}.items() if c not in mentions.columns})
    m = cut(m.select("entity_id", "type", "name", "confidence", "evidence_id", "local_id", "props", "key"))  # read thrice, extracted once
    names = m.groupBy("entity_id", "type", "name").agg(F.min(order).alias("_o"), F.max("confidence").alias("_c"), F.min("key").alias("_k"))
    head = names.groupBy("entity_id", "type").agg(F.min_by("name", "_o").alias("canonical_name"), F.sort_array(F.collect_set("name")).alias("names"), F.max("_c").alias("confidence"), F.min("_k").alias("key"))
    seen = m.groupBy("entity_id").agg(F.countDistinct("evidence_id").alias("evidence_count"))
    each = m.select("entity_id", order.alias("_o"), F.explode("props").alias("k", "v")).where("v IS NOT NULL").groupBy("entity_id", "k").agg(F.min_by("v", "_o").alias("v"))
    bags = each.groupBy("entity_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("attributes"))
    found = head.join(seen, "entity_id").join(bags, "entity_id", "left")
    return found.select("entity_id", "type", "canonical_name", F.array_remove("names", F.col("canonical_name")).alias("aliases"), F.coalesce("attributes", F.expr("map()").cast("map<string,string>")).alias("attributes"), "key", "confidence", "evidence_count")


def support(mentions: DataFrame) -> DataFrame:
    """entity_id, evidence_id, confidence: which evidence names an entity, and how surely."""
    return mentions.groupBy("entity_id", "evidence_id").agg(F.max("confidence").alias("confidence"))


def merged_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two registries as one: what old says of an entity stays, new adds aliases and attributes that it lacks, and the greater confidence."""
    n = new.select("entity_id", *[F.col(c).alias(f"_{c}") for c in ("type", "canonical_name", "aliases", "attributes", "key", "confidence", "evidence_count")])
    empty, none = F.array().cast("array<string>"), F.expr("map()").cast("map<string,string>")
    name = F.coalesce("canonical_name", "_canonical_name")
    aliases = F.array_remove(F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce("aliases", empty), F.array("_canonical_name"), F.coalesce("_aliases", empty)), lambda x: x.isNotNull()))), name)
    have = F.coalesce("attributes", none)
    more = F.map_filter(F.coalesce("_attributes", none), lambda k, _: ~F.array_contains(F.map_keys(have), k))
    return old.join(n, "entity_id", "full").select(
        "entity_id", F.coalesce("type", "_type").alias("type"), name.alias("canonical_name"), aliases.alias("aliases"), F.map_concat(have, more).alias("attributes"), F.coalesce("key", "_key").alias("key"),
        F.greatest("confidence", "_confidence").alias("confidence"), (F.coalesce("evidence_count", F.lit(0)) + F.coalesce("_evidence_count", F.lit(0))).alias("evidence_count"),
    )


@dataclass(frozen=True)
class Resolved:
    mentions: DataFrame  # mentions with entity_id, method, score
    registry: DataFrame  # the old one with what the mentions add
    suggestions: DataFrame  # entity_id, candidate_id, score: new entities that may be known ones
    relations: DataFrame  # relations with src and dst, entities both


def resolve(mentions: DataFrame, relations: DataFrame, known: DataFrame | None = None, merge: float = MERGE, suggest: float = SUGGEST) -> Resolved:
    """Normalised mentions as entities of the registry `known`, or new ones.

    An equal key decides; then a name or alias of the same type that is near enough; the
    rest are new, with a suggestion where something is fairly near. Mentions of one key, or
    of one type and name, are resolved once. New entities are held against each other too,
    each against those that came before it by evidence and local id; where that makes
    chains, all of a chain are its first. The result doesn't depend on the order of rows.
    relations(evidence_id, source, target, ...) lead to entities; loops go.
    """
    m = resolve_keys(mentions)
    order = F.struct("evidence_id", "local_id")
    heads = cut(m.groupBy("entity_id").agg(F.min(order).alias("_o"), F.min_by("type", order).alias("type"), F.min_by("name", order).alias("name"), F.min("key").alias("key"), F.min_by(F.col("props")["dob"], order).alias("birth"), F.min_by(F.col("props")["nationality"], order).alias("nationality")))
    columns = ["id", "type", "name", "birth", "nationality", "aliases", "_o"]
    there = None
    sure = heads.limit(0).select("entity_id", F.col("entity_id").alias("to"))
    if known is not None:
        there = known.select(F.col("entity_id").alias("id"), "type", F.col("canonical_name").alias("name"), F.col("attributes")["dob"].alias("birth"), F.col("attributes")["nationality"].alias("nationality"), "aliases", "key")
        keyed = there.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("to"))
        sure = cut(heads.join(keyed, "key").select("entity_id", "to"))
    rest = heads.join(sure, "entity_id", "left_anti")
    new = rest.select(F.col("entity_id").alias("id"), "type", "name", "birth", "nationality", F.array().cast("array<string>").alias("aliases"), "_o")
    every = new.select(*columns) if there is None else new.select(*columns).unionByName(there.withColumn("_o", F.lit(None).cast(dict(new.dtypes)["_o"])).select(*columns))
    every = cut(every)
    scored = scored_candidates(new.select(F.col("id").alias("mention"), "type", "name", "birth", "nationality"), every, suggest).join(every.select("id", F.col("_o").alias("_theirs")), "id")
    scored = scored.join(new.select(F.col("id").alias("mention"), "_o"), "mention").where("mention <> id AND (_theirs IS NULL OR _theirs < _o)")
    best = cut(scored.groupBy("mention").agg(F.max_by(F.struct("id", "score"), F.struct("score", F.col("_theirs").isNull(), "_theirs", "id")).alias("_b")).select("mention", "_b.*"))
    to = best.where(F.col("score") >= merge).select(F.col("mention").alias("entity_id"), F.col("id").alias("to"), "score")
    jumps = to.select("entity_id", "to")
    while True:  # each pass halves the chains
        nxt = jumps.select(F.col("entity_id").alias("to"), F.col("to").alias("_next"))
        moved = cut(jumps.join(nxt, "to", "left").select("entity_id", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_moved")))
        jumps = moved.drop("_moved")
        if moved.where("_moved").isEmpty():
            break
    method = F.concat(F.lit("fuzzy:"), F.format_number("score", 2))
    found = sure.select("entity_id", "to", F.lit("deterministic").alias("method"), F.lit(1.0).alias("score")).unionByName(jumps.join(to.select("entity_id", "score"), "entity_id").select("entity_id", "to", method.alias("method"), "score"))
    found = cut(found)
    out = m.join(found, "entity_id", "left").select(*[c for c in m.columns if c != "entity_id"], F.coalesce("to", "entity_id").alias("entity_id"), F.coalesce("method", F.lit("new")).alias("method"), "score")
    out = cut(out)
    suggestions = best.where(F.col("score") < merge).select(F.col("mention").alias("entity_id"), F.col("id").alias("_id"), "score")
    suggestions = suggestions.join(jumps.select(F.col("entity_id").alias("_id"), "to"), "_id", "left").select("entity_id", F.coalesce("to", "_id").alias("candidate_id"), "score").where("entity_id <> candidate_id")
    now = registry(out)
    ends = out.select("evidence_id", "local_id", "entity_id").distinct()
    r = relations
    for end, column in (("source", "src"), ("target", "dst")):
        r = r.join(ends.select("evidence_id", F.col("local_id").alias(end), F.col("entity_id").alias(column)), ["evidence_id", end])
    return Resolved(out, now if known is None else merged_registry(known, now), suggestions, r.where("src <> dst"))


def decide(scored: DataFrame, merge: float = MERGE, suggest: float = SUGGEST) -> DataFrame:
    """scored(mention, id, score) to one decision a mention: merge into the best, create with a suggestion, or create."""
    best = scored.groupBy("mention").agg(F.max_by(F.struct("id", "score"), "score").alias("_b"))
    score = F.col("_b.score")
    action = F.when(score >= merge, "merge").when(score >= suggest, "suggest").otherwise("create")
    return best.select("mention", action.alias("action"), F.when(score >= suggest, F.col("_b.id")).alias("id"), score.alias("score"))


def identity_score(name_score: Column, same_birth: Column, same_nationality: Column, birth: float = 0.07, nationality: float = 0.03) -> Column:
    """Name similarity with a premium for equal birth dates and nationalities, at most 1."""
    add = lambda c, x: F.when(F.coalesce(c, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), name_score + add(same_birth, birth) + add(same_nationality, nationality))


def facts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with a status, review items): what isn't accepted is queued, open or rejected."""
    f = rows.withColumn("status", confidence_gate(F.col("confidence")))
    items = f.where(F.col("confidence") < ACCEPTED).withColumn("state", F.when(F.col("confidence") >= REVIEW, "open").otherwise("rejected"))
    return f, items


def written(found: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, SUPPORTED_BY edges) of accepted mention facts(evidence_id, entity_id, status)."""
    ok = found.where("status = 'accepted'").select("entity_id", "evidence_id").distinct()
    v = entities.join(ok.select("entity_id"), "entity_id", "left_semi").select(F.col("entity_id").alias("vid"), F.lower("type").alias("tag"), F.col("canonical_name").alias("label"), "confidence")
    return v, ok.select(F.col("entity_id").alias("src"), F.col("evidence_id").alias("dst"), F.lit("SUPPORTED_BY").alias("edge_type"), F.lit(0).cast("long").alias("rank"))


@dataclass(frozen=True)
class Written:
    vertices: DataFrame  # entities, as entity_rows
    evidence: DataFrame  # evidence vertices
    edges: DataFrame  # relationships, as relationship_rows
    support: DataFrame  # SUPPORTED_BY edges
    values: DataFrame  # field value vertices
    holds: DataFrame  # HAS_FIELD_VALUE edges


def write(evidence: DataFrame, mentions: DataFrame, relations: DataFrame, entities: DataFrame) -> Written:
    """What the graph gets of accepted facts: mentions and relations of `facts`, entities of the registry.

    A person's attributes, and those of the documents that an accepted HAS_DOCUMENT gives
    them, are indexed for the person. A relation is written though an end of it was not
    accepted. Relations of an enrichment (origin) are proposed, the others accepted.
    """
    ok, rel = mentions.where("status = 'accepted'"), relations.where("status = 'accepted'")
    named = entities.withColumnRenamed("canonical_name", "name")
    last = ok.groupBy("entity_id").agg(F.max("evidence_id").alias("evidence_id"))
    origin = F.col("origin") if "origin" in rel.columns else F.lit("extraction")
    edges = store.relationship_rows(rel.where(origin != "enrichment")).unionByName(store.relationship_rows(rel.where(origin == "enrichment"), "proposed"))
    bag = F.map_filter("attributes", lambda k, v: v.isNotNull())
    persons = named.where("type = 'Person'").join(ok.select("entity_id"), "entity_id", "left_semi").select(F.col("entity_id").alias("owner"), F.lit("").alias("document_id"), F.lit("").alias("document_type"), bag.alias("props"))
    documents = named.select(F.col("entity_id").alias("dst"), bag.alias("props"))
    held = rel.where("type = 'HAS_DOCUMENT'").select("src", "dst").distinct().join(documents, "dst")
    held = held.select(F.col("src").alias("owner"), F.col("dst").alias("document_id"), F.coalesce(F.col("props")["document_type"], F.lit("document")).alias("document_type"), "props")
    values, holds = graph_store.field_value_index(persons.unionByName(held))
    return Written(store.entity_rows(named.join(last, "entity_id")), store.evidence_rows(evidence), edges, store.supported_by(ok.select("entity_id", "evidence_id", "confidence")), values, holds)


def shared_identifiers(edges: DataFrame, entities: DataFrame, max_fanout: int) -> DataFrame:
    """src, dst, type, label, confidence: RELATED_TO between all holders of a phone, e-mail, address or account with at most max_fanout of them."""
    held = edges.where(F.col("edge_type").isin("HAS_PHONE", "HAS_EMAIL", "LOCATED_AT", "HAS_ACCOUNT")).select(F.col("src").alias("person"), F.col("dst").alias("connector")).distinct()
    kinds = entities.where(F.col("type").isin("Phone", "Email", "Address", "BankAccount")).select(F.col("entity_id").alias("connector"), F.col("type").alias("tag"))
    found = shared_identifier_pairs(held.join(kinds, "connector"), max_fanout)
    return found.select(F.col("p1").alias("src"), F.col("p2").alias("dst"), F.lit("RELATED_TO").alias("type"), "label", "confidence")


def enriched(edges: DataFrame, entities: DataFrame, earlier: DataFrame | None = None, inferred: DataFrame | None = None, max_fanout: int = MAX_FANOUT) -> DataFrame:
    """New proposals, gated: of shared identifiers, and inferred(src, dst, type, label, confidence) of any model, as far as their ends and types are known."""
    p = shared_identifiers(edges, entities, max_fanout)
    if inferred is not None:
        there = edges.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
        ok = inferred.where(F.col("type").isin(*RELATIONSHIPS))
        for end in ("src", "dst"):
            ok = ok.join(there.withColumnRenamed("vid", end), end, "left_semi")
        p = p.unionByName(ok.select(*p.columns))
    return proposals(p, earlier)


def proposals(pairs: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Enrichment pairs(src, dst, type, label, confidence) without loops, repeats and those of earlier runs; gated, status proposed where accepted."""
    p = pairs.where("src <> dst").dropDuplicates(["src", "dst", "type"])
    if earlier is not None:
        p = p.join(earlier.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")
    gate = confidence_gate(F.col("confidence"))
    return p.withColumn("status", F.when(gate == "accepted", "proposed").otherwise(gate))


def review(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items(item_id, state, ...) after decisions(item_id, approve boolean): open ones become approved or rejected; others stay."""
    d = decisions.groupBy("item_id").agg(F.bool_and("approve").alias("_a"))
    now = F.when((F.col("state") == "open") & F.col("_a").isNotNull(), F.when(F.col("_a"), "approved").otherwise("rejected")).otherwise(F.col("state"))
    return items.join(d, "item_id", "left").withColumn("state", now).drop("_a")


def queue(items: DataFrame, state: str = "open", limit: int = 200, facts: DataFrame | None = None) -> DataFrame:
    """The oldest items of a state, with the kind of their fact if facts(fact_id, kind) are given."""
    found = items.where(F.col("state") == state).orderBy("created_at", "item_id").limit(limit)
    return found if facts is None else found.join(facts.select("fact_id", "kind"), "fact_id", "left")


def evidence_list(evidence: DataFrame, status: str | None = None, limit: int = 50, log: DataFrame | None = None) -> DataFrame:
    """The latest evidence(evidence_id, status, uploaded_at, ...), 200 rows at most, each with its last entry of log(evidence_id, stage, at, detail)."""
    e = evidence if status is None else evidence.where(F.col("status") == status)
    top = e.orderBy(F.desc("uploaded_at"), "evidence_id").limit(min(limit, 200))
    return top if log is None else top.join(last_entries(log.join(top.select("evidence_id"), "evidence_id", "left_semi")), "evidence_id", "left")


def entity_list(entities: DataFrame, entity_type: str | None = None, text: str | None = None, limit: int = 100) -> DataFrame:
    """The entities last changed, of a type and with a text in the name, whatever its case."""
    e = entities if entity_type is None else entities.where(F.col("type") == entity_type)
    e = e.where(F.lower("canonical_name").contains(text.strip().lower())) if text and text.strip() else e
    return e.orderBy(F.desc("updated_at"), "entity_id").limit(limit)


@dataclass(frozen=True)
class Approved:
    entities: DataFrame  # rows of the registry to write, with evidence_id
    support: DataFrame  # SUPPORTED_BY edges to write
    edges: DataFrame  # relationships to write, same_as among them
    registry: DataFrame  # the registry with the names of what is the same
    facts: DataFrame  # facts, written or rejected
    items: DataFrame  # review items after the decisions


def decided(items: DataFrame, facts: DataFrame, entities: DataFrame, decisions: DataFrame) -> Approved:
    """Reviews carried out: decisions(item_id, approve) on open items(item_id, fact_id, state, ...).

    facts(fact_id, kind, evidence_id, entity_id, src, dst, type, label, attributes map, confidence,
    status). An approved entity is written with its support, a relationship as an accepted
    edge; a merge suggestion (src the new, dst the known entity) gives the known one the
    new one's names and links the two as same_as. Facts become written or rejected.
    """
    after = review(items, decisions)
    now = after.join(items.where("state = 'open'").select("item_id"), "item_id", "left_semi").where(F.col("state").isin("approved", "rejected")).select("fact_id", F.col("state").alias("_state")).distinct()
    f = facts.join(now, "fact_id", "left")
    yes = f.where("_state = 'approved'")
    one = yes.where("kind = 'entity'").select("entity_id", "evidence_id", "confidence")
    same = yes.where("kind = 'merge_suggestion'")
    rel = yes.where("kind = 'relationship'").select("src", "dst", "type", "confidence", "evidence_id", "attributes", "label")
    rel = rel.unionByName(same.select("src", "dst", F.lit("RELATED_TO").alias("type"), "confidence", "evidence_id", F.lit(None).cast("map<string,string>").alias("attributes"), F.lit("same_as").alias("label")))
    names = entities.select(F.col("entity_id").alias("src"), F.explode(F.concat(F.array("canonical_name"), "aliases")).alias("_name"))
    more = same.select("src", "dst").distinct().join(names, "src").groupBy(F.col("dst").alias("entity_id")).agg(F.collect_set("_name").alias("_names"))
    aliases = F.array_remove(F.array_sort(F.array_union("aliases", F.coalesce("_names", F.array().cast("array<string>")))), F.col("canonical_name"))
    status = F.when(F.col("_state") == "approved", "written").when(F.col("_state") == "rejected", "rejected").otherwise(F.col("status"))
    return Approved(
        entities.join(one.groupBy("entity_id").agg(F.max("evidence_id").alias("evidence_id")), "entity_id"), store.supported_by(one), store.relationship_rows(rel),
        entities.join(more, "entity_id", "left").withColumn("aliases", aliases).drop("_names"), f.withColumn("status", status).drop("_state"), after,
    )


def delete_evidence(mentions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions left, entity_ids orphaned) once the evidence gone(evidence_id) and all it said are removed."""
    left = mentions.join(gone.select("evidence_id"), "evidence_id", "left_anti")
    hit = mentions.join(gone.select("evidence_id"), "evidence_id", "left_semi").select("entity_id").distinct()
    return left, hit.join(left.select("entity_id").distinct(), "entity_id", "left_anti")


def delete_cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the evidence gone(evidence_id) and what only it supports.

    tables: evidence, facts and items (evidence_id, ...), support(entity_id, evidence_id, ...),
    registry(entity_id, ...), vertices(vid, ...), edges(src, dst, ...). Entities left without
    support leave the registry and, like the evidence, the graph with all their edges.
    """
    out = dict(tables)
    for name in ("evidence", "facts", "items"):
        if name in out:
            out[name] = out[name].join(gone.select("evidence_id"), "evidence_id", "left_anti")
    out["support"], orphans = delete_evidence(tables["support"], gone)
    out["registry"] = tables["registry"].join(orphans, "entity_id", "left_anti")
    removed = orphans.select(F.col("entity_id").alias("vid")).unionByName(gone.select(F.col("evidence_id").alias("vid")))
    out["vertices"], out["edges"] = graph_store.delete_vertices(tables["vertices"], tables["edges"], removed, with_edges=True)
    return out


def stopped(evidence: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """(rows that go on to a stage, rows that a request to cancel stops before it, now cancelled)."""
    asked = F.coalesce("cancel_requested", F.lit(False))
    return evidence.where(~asked), evidence.where(asked).withColumn("status", F.lit("cancelled")).withColumn("error", F.lit(f"{stage}: stopped by user"))


def cancelled(evidence: DataFrame, ids: DataFrame) -> DataFrame:
    """evidence with a request to cancel for those of ids(evidence_id) that are under way or wait."""
    mark = ids.select("evidence_id", F.lit(True).alias("_asked")).distinct()
    active = F.col("status").isin("uploaded", *ACTIVE)
    return evidence.join(mark, "evidence_id", "left").withColumn("cancel_requested", F.coalesce("cancel_requested", F.lit(False)) | (F.coalesce("_asked", F.lit(False)) & active)).drop("_asked")


def retried(evidence: DataFrame, ids: DataFrame) -> DataFrame:
    """evidence with those of ids(evidence_id) that failed or were cancelled ready for another try."""
    mark = ids.select("evidence_id", F.lit(True).alias("_again")).distinct()
    again = F.coalesce("_again", F.lit(False)) & F.col("status").isin("failed", "cancelled")
    e = evidence.join(mark, "evidence_id", "left").withColumn("_again", again)
    return e.withColumns({"status": F.when(F.col("_again"), "uploaded").otherwise(F.col("status")), "error": F.when(~F.col("_again"), F.col("error")), "cancel_requested": F.col("cancel_requested") & ~F.col("_again")}).drop("_again")


def swept(evidence: DataFrame) -> DataFrame:
    """After a restart: rows that were under way are failed and can be tried again."""
    active = F.col("status").isin(*ACTIVE)
    return evidence.withColumn("error", F.when(active, F.concat("status", F.lit(": interrupted"))).otherwise(F.col("error"))).withColumn("status", F.when(active, "failed").otherwise(F.col("status")))


def last_entries(log: DataFrame) -> DataFrame:
    """The last entry of each evidence in log(evidence_id, stage, at, detail)."""
    last = log.groupBy("evidence_id").agg(F.max_by(F.struct("stage", "at", "detail"), F.struct("at", "stage", "detail")).alias("_l"))
    return last.select("evidence_id", "_l.*")


def ranked(found: DataFrame, group: str, score: str, tie: str, top: int) -> DataFrame:
    """The top rows of each group; Spark limits each partition before it shuffles."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
