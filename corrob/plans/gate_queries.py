"""Queries of graphs (G), text (N), quality gates (Q) and streams (I)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corrob.functions import columns as C
from corrob.functions.columns import half_up
from corrob.functions.sources import family_sql, source_family
from corrob.operators import aggregate as A
from corrob.operators import graph as G
from corrob.operators import quality as Q
from corrob.operators import records as R
from corrob.operators import rules as L
from corrob.operators import text as N
from corrob.plans import views as V
from corrob.plans.aggregate_queries import AUDITED, audited
from corrob.plans.registry import ORACLE, query
from corrob.sources.shared import clear_at_exit, new_path, stash
from corrob.streaming import imports as P
from corrob.streaming import incremental as I
from corrob.streaming.summaries import SURFACE, Contract

EDGES = V.ENTITIES + ", edges as (select a, b, count(*) weight from (select x a, unnest(countries) b from (select countries, unnest(countries) x from entities)) where a < b group by all)"


STRONG = "strong as (select a, b, weight from edges where weight >= (select quantile_cont(weight, 0.9) from edges))"


def all_edges(spark, d):
    return G.co_occurrence(V.entities(spark, d), "countries")[1]


def backbone(spark, d):
    """The strong ties of a network that is nearly complete: pairs of nations at or above the 0.9 quantile of weights."""
    e = all_edges(spark, d)
    least = e.agg(F.percentile("weight", F.lit(0.9)).alias("least"))
    return e.join(F.broadcast(least), F.col("weight") >= F.col("least")).select("a", "b", "weight")  # one row


@query("g1_co_occurrence", f"with {EDGES} select * from edges")
def g1(spark, d):
    return G.co_occurrence(V.entities(spark, d), "countries")[1]


@query("g1b_nodes", f"with {V.ENTITIES} select unnest(countries) node, count(*) entities from entities group by 1")
def g1b(spark, d):
    return G.co_occurrence(V.entities(spark, d), "countries")[0]


def _between(edges: str) -> str:
    """Betweenness by the shortest paths of all pairs: those through a node have lengths that add up."""
    return f"""e as (select a, b from {edges} union select b, a from {edges}), n as (select distinct a node from e), walk(s, t, d) as (select node, node, 0 from n union select s, b, d + 1 from walk join e on a = t where d < (select count(*) from n)),
  far as (select s, t, min(d) d from walk group by all), path(s, t, d) as (select node, node, 0 from n union all select p.s, e.b, p.d + 1 from path p join e on e.a = p.t join far f on f.s = p.s and f.t = e.b and f.d = p.d + 1),
  sigma as (select s, t, d, count(*) c from path group by all), through as (select x.t node, sum(x.c * y.c / z.c::double) / 2 bc from sigma x join sigma y on y.s = x.t join sigma z on z.s = x.s and z.t = y.t and z.d = x.d + y.d where x.s <> x.t and y.t <> x.t and x.s <> y.t group by x.t)
  select node, floor(coalesce(bc, 0) * 1000000 + 0.5) / 1000000 betweenness, floor(coalesce(bc, 0) / greatest(1.0, ((select count(*) from n) - 1) * ((select count(*) from n) - 2) / 2.0) * 1000000 + 0.5) / 1000000 normalized from n left join through using (node)"""


def _cut(edges: str) -> str:
    """Nodes without which their neighbors no longer all reach each other."""
    return f"""e as (select a, b from {edges} union select b, a from {edges}), n as (select distinct a node from e), reach(gone, start_, node) as (select e.a, e.b, e.b from e union select r.gone, r.start_, e.b from reach r join e on e.a = r.node where e.b <> r.gone),
  l as (select gone, start_, min(node) label from reach group by all) select node, coalesce(c > 1, false) articulation from n left join (select gone, count(distinct label) c from l group by gone) on gone = node"""


def _shown(df):
    return df.select("node", half_up(F.col("betweenness"), 6).alias("betweenness"), half_up(F.col("normalized"), 6).alias("normalized"))


@query("g2_betweenness", f"with recursive {EDGES}, {_between('edges')}")
def g2(spark, d):
    return _shown(G.betweenness(all_edges(spark, d)))


@query("g2b_backbone_betweenness", f"with recursive {EDGES}, {STRONG}, {_between('strong')}")
def g2b(spark, d):
    return _shown(G.betweenness(backbone(spark, d)))


@query("g3_articulation", f"with recursive {EDGES}, {_cut('edges')}")
def g3(spark, d):
    return G.articulation_points(all_edges(spark, d))


@query("g3b_backbone_articulation", f"with recursive {EDGES}, {STRONG}, {_cut('strong')}")
def g3b(spark, d):
    return G.articulation_points(backbone(spark, d))


@query("g4_concentration", f"with {V.ENTITIES}, g as (select program, n, count(*) c from (select program, unnest(countries) n from entities) group by all) select program, cast(floor(sum(c * c)::double * 10000.0 / (sum(c) * sum(c))::double + 0.5) as bigint) hhi from g group by program")
def g4(spark, d):
    e = V.entities(spark, d).select("program", F.explode("countries").alias("n")).withColumn("one", F.lit(1))
    return A.hhi(e, ["program"], "n", "one").select("program", "hhi")


_PART_WORDS = "string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' ')"


@query("g5_search_entities", f"""with p as (select p_partkey, p_name, p_brand || ' (' || p_type || ')' alias from part), t as (select *, {_PART_WORDS.format(x='p_name')} a, {_PART_WORDS.format(x='alias')} b from p),
  q as (select p_partkey query, case when p_partkey % 100 = 0 then p_type || ', ' || p_brand else split_part(p_name, ' ', 2) || '-' || upper(split_part(p_name, ' ', 1)) end said from part where p_partkey % 50 = 0), w as (select query, {_PART_WORDS.format(x='said')} w from q)
  select query, p_partkey "key", case when not list_has_all(a, w) then alias end alias from w join t on list_has_all(a, w) or list_has_all(b, w)""")
def g5(spark, d):
    """Names of parts, with brand and type as alias; every fiftieth part asks for its type and brand or for its name turned round."""
    p = V.table(spark, d, "part").withColumn("aliases", F.array(F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))))
    index = stash(L.name_index(p, "p_partkey", "p_name", "aliases"), "name-index")
    q = p.where("p_partkey % 50 = 0").select("p_partkey", F.expr("case when p_partkey % 100 = 0 then p_type || ', ' || p_brand else split_part(p_name, ' ', 2) || '-' || upper(split_part(p_name, ' ', 1)) end").alias("said"))
    return L.search_names(index, q, "p_partkey", "said")


def _graph(spark, d):
    at = lambda df: df.where("year = 2000")
    corridors = V.regions(spark, d).where("area <> 2").select(F.col("region").alias("corridor"))
    return G.evidence_graph(V.regions(spark, d), at(V.conflicts(spark, d)), at(V.inflows(spark, d)), at(V.outflows(spark, d)), corridors)


GRAPH = f"""{V.EVIDENCE}, i as (select * from inflows where year = 2000), o as (select * from outflows where year = 2000), c as (select * from conflicts where year = 2000), co as (select region corridor from regions where area <> 2),
nodes0 as (select 'region:' || region id, 'region' kind, 1.0::double w from regions union all select 'corridor:' || corridor, 'corridor', 1 from co union all select 'actor:' || actor, 'actor', intensity from c union all select 'country:' || origin, 'country', qty from i
  union all select 'precursor:' || product, 'precursor', qty from i union all select 'source:' || source_name, 'source', 1 from (select source_name from c union all select source_name from i union all select source_name from o) where source_name is not null),
edges as (select 'actor:' || actor a, 'region:' || region b, 'conflict_pressure' relation, intensity::double weight, source_name, source_url from c union all select 'source:' || source_name, 'actor:' || actor, 'reports', 1, source_name, source_url from c where source_name is not null
  union all select 'country:' || origin, 'region:' || region, 'precursor_inflow', weighted::double / 10000, source_name, source_url from i union all select 'source:' || source_name, 'country:' || origin, 'reports', weighted::double / 10000 / qty, source_name, source_url from i where source_name is not null
  union all select 'region:' || region, case when corridor in (select corridor from co) then 'corridor:' || corridor else 'region:' || corridor end, 'drug_outflow', qty, source_name, source_url from o union all select 'source:' || source_name, 'region:' || region, 'reports', 1, source_name, source_url from o where source_name is not null)"""


@query("g6_evidence_nodes", f"with {GRAPH} select id, kind, max(w) weight from nodes0 group by all")
def g6(spark, d):
    return _graph(spark, d)[0]


@query("g6b_evidence_edges", f"with {GRAPH} select relation, count(*) n, cast(sum(cast(round(weight * 10000) as bigint)) as bigint) weight from edges group by relation")
def g6b(spark, d):
    return _graph(spark, d)[1].groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("weight") * 10_000).cast("long")).alias("weight"))


@query("g7_evidence_ledger", f"with {GRAPH} select {family_sql('source_name', 'source_url')} family, relation, split_part(b, ':', 2) label, count(*) n from edges group by all")
def g7(spark, d):
    e = _graph(spark, d)[1].groupBy("source_name", "source_url", "relation", F.split_part("b", F.lit(":"), F.lit(2)).alias("label")).agg(F.count(F.lit(1)).alias("k"))
    return e.groupBy(source_family(F.col("source_name"), F.col("source_url")).alias("family"), "relation", "label").agg(F.sum("k").alias("n"))


# --- text


_BLANKS = r"[\s\x0B\p{{Z}}\x{{FEFF}}]+"
_BODY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis'), '[0-9]{{3,}}', '#', 'g'), '" + _BLANKS + "', ' ', 'g'))"
_STRIP = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '" + _BLANKS + "', ' ', 'g'))"
KEYWORDS = ["nicht", "track", "ther", "Para"]


def _items(tag: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all(html, '(?is)<{tag}\b[^>]*>(.*?)</{tag}>', 1), lambda x: {_STRIP.format(x='x')}), lambda t: t <> '')"


def _read(tag: str | None, source: str = "pages") -> str:
    """Table read_: page_id, url, t (the text), content_sha, item_sha: items first, stripped; then normalised."""
    said = f"case when len(items) > 0 then array_to_string(items, chr(10)) else {_STRIP.format(x='html')} end"
    return f"""i as (select page_id, url, coalesce(html, '') html from {source}), it as (select *, {_items(tag) if tag else "[]::varchar[]"} items from i), pg as (select page_id, url, items, {_BODY.format(x=said)} t from it),
  read_ as (select page_id, url, t, sha256(t) content_sha, case when len(items) > 0 then sha256(array_to_string(list_sort(items), chr(31))) else '' end item_sha from pg)"""


def _seen(tag: str | None, source: str = "pages") -> str:
    """Table seen: observations, with their fingerprints."""
    return f"""{_read(tag, source)}, k as (select *, unnest({KEYWORDS}) keyword from read_), h as (select *, instr(lower(t), lower(keyword)) pos from k),
  seen as (select page_id, keyword, trim(substr(t, greatest(1, pos - 140), pos - greatest(1, pos - 140) + len(keyword) + 180)) excerpt, content_sha, item_sha,
  sha256(coalesce(url, '') || chr(31) || keyword || chr(31) || case when item_sha = '' then content_sha else item_sha end) fingerprint from h where pos > 0)"""


@query("n1_keyword_observations", f"with {_seen('article')} select * from seen")
def n1(spark, d):
    return N.keyword_observations(V.table(spark, d, "pages"), KEYWORDS, "article")


@query("n2_page_fingerprint", f"with {_read('b')} select page_id, case when item_sha = '' then content_sha else item_sha end fingerprint from read_")
def n2(spark, d):
    return N.page_fingerprints(V.table(spark, d, "pages"), "b")


#: What an earlier run saw: pages of one host said another word then.
_THEN = "case when contains(url, 'example.com') then replace(html, 'ther', 'thor') else html end"


@query("n3_dedupe_prior", f"with now_ as (with {_seen('article')} select * from seen), then_ as (with {_seen('article', f'(select page_id, url, {_THEN} html from pages)')} select * from seen) select keyword, count(*) n, count(*) filter (fingerprint in (select fingerprint from then_)) suppressed from now_ group by keyword")
def n3(spark, d):
    pages = V.table(spark, d, "pages").select("page_id", "url", "html")
    then = N.keyword_observations(pages.withColumn("html", F.expr(_THEN)), KEYWORDS, "article")
    now = N.keyword_observations(pages, KEYWORDS, "article").select("page_id", "keyword", "fingerprint")
    new = N.dedupe_against(now, then, ["fingerprint"]).groupBy("keyword").agg(F.count(F.lit(1)).alias("new"))
    all_ = now.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    return all_.join(new, "keyword", "left").select("keyword", "n", (F.col("n") - F.coalesce("new", F.lit(0))).alias("suppressed"))


@query("n4_hash_chain", """with recursive m as (select conv_id, turn, sha256(coalesce(role, '') || chr(31) || coalesce(text, '')) p, row_number() over (partition by conv_id order by turn) rn from conversations),
  ch as (select conv_id, turn, rn, '' previous_hash, sha256(p) hash from m where rn = 1 union all select m.conv_id, m.turn, m.rn, ch.hash, sha256(ch.hash || m.p) from ch join m on m.conv_id = ch.conv_id and m.rn = ch.rn + 1) select conv_id, turn, previous_hash, hash from ch""")
def n4(spark, d):
    return N.hash_chain(V.table(spark, d, "conversations"), "conv_id", "turn", F.concat(F.coalesce("role", F.lit("")), F.lit("\x1f"), F.coalesce("text", F.lit(""))))


_SAID = "concat(coalesce(role, ''), '\x1f', coalesce(text, ''))"


@query("n4b_verify_chain", "with t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) rn from conversations) select conv_id, count(*) links, case when conv_id % 5 = 0 and count(*) > 1 then 1 else 0 end broken, case when conv_id % 5 = 0 then max(case when rn = 2 then turn end) end first_broken from t group by conv_id")
def n4b(spark, d):
    """Chains made in two runs, the second going on from the last hashes of the first; the second record of every fifth chain is then another."""
    c = V.table(spark, d, "conversations").withColumn("rn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    first = stash(N.hash_chain(c.where("rn <= 3"), "conv_id", "turn", F.expr(_SAID)), "chain")
    then = N.hash_chain(c.where("rn > 3"), "conv_id", "turn", F.expr(_SAID), N.last_hashes(first, "conv_id", "turn"))
    said = F.when((F.col("conv_id") % 5 == 0) & (F.col("rn") == 2), F.concat(F.expr(_SAID), F.lit("!"))).otherwise(F.expr(_SAID))
    chained = first.unionByName(then).join(c.select("conv_id", "turn", said.alias("said")), ["conv_id", "turn"])
    return N.verify_chain(chained, "conv_id", "turn", F.col("said"))



@query("f25_normalize_body", f"select page_id, sha256({_BODY.format(x="coalesce(html, '')")}) body from pages")
def f25(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.sha2(C.normalize_body(F.col("html")), 256).alias("body"))


@query("f26_strip_tags", f"select page_id, sha256({_STRIP.format(x='html')}) as \"text\" from pages")
def f26(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.sha2(C.strip_tags(F.col("html")), 256).alias("text"))


@query("f27_extract_items", f"select page_id, cast(len({_items('li')}) as int) n from (select page_id, coalesce(html, '') html from pages)")
def f27(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.size(C.extract_items(F.col("html"), "li")).alias("n"))


# --- quality


def _rows(pairs: list[tuple[str, str]], source: str) -> str:
    return " union all ".join(f"select '{n}' as \"rule\", count(*) filter (not coalesce({c}, false)) failures, count(*) filter (not coalesce({c}, false)) = 0 passed from {source}" for n, c in pairs)


_ORDER_RULES = [("price positive", "o_totalprice > 0"), ("status known", "o_orderstatus in ('F', 'O')"), ("dated before 2001", "o_orderdate < timestamp '2001-01-01'")]


@query("q1_expectations", _rows(_ORDER_RULES, "orders"))
def q1(spark, d):
    return Q.expectations(V.table(spark, d, "orders"), {n: F.expr(c) for n, c in _ORDER_RULES})


@query("q2_registry_gate", "with s as (select s_suppkey % 40 id, s_name, s_acctbal from supplier) " + _rows([("named", "s_name like 'Supplier#%'"), ("in credit", "s_acctbal > 0")], "s") + " union all select 'unique ids', count(*), count(*) = 0 from (select id from s group by id having count(*) > 1) union all select 'required ids present', count(*), count(*) = 0 from (select n_nationkey * 2 id from nation) where id not in (select id from s)")
def q2(spark, d):
    s = V.table(spark, d, "supplier").withColumn("id", F.col("s_suppkey") % 40)
    need = V.table(spark, d, "nation").select((F.col("n_nationkey") * 2).alias("id"))
    return Q.registry_gate(s, "id", {"named": F.col("s_name").like("Supplier#%"), "in credit": F.col("s_acctbal") > 0}, need)


_FLOW = "case when partkey % 9 = 1 then 'derived_subtotal' else 'seizure' end"
_FIT = "case when partkey % 9 = 1 and orderkey % 5 <> 0 then 'ineligible_derived' when orderkey % 10 >= 6 and supp % 4 <> 0 then 'ineligible_non_exact' when size > 45 then 'ineligible_incompatible_basis' else 'eligible' end"
_Q3 = [("non-exact is ineligible_non_exact", "r = 'exact' or fit = 'ineligible_non_exact'"), ("exact isn''t ineligible_non_exact", "r <> 'exact' or fit <> 'ineligible_non_exact'"), ("eligible is exact, not derived, grouped", "fit <> 'eligible' or (r = 'exact' and kind <> 'derived_subtotal' and g is not null)"),
       ("derived is ineligible_derived", "kind <> 'derived_subtotal' or fit = 'ineligible_derived'"), ("ineligible_derived is derived", "fit <> 'ineligible_derived' or kind = 'derived_subtotal'"), ("derived has no group", "kind <> 'derived_subtotal' or g is null"),
       ("incompatible has no group", "fit <> 'ineligible_incompatible_basis' or g is null"), ("quantity is known and not negative", "qty >= 0")]


@query("q3_audited_flow_gate", f"with {AUDITED}, x as (select quantity_relation r, aggregation_group g, qty, {_FLOW} kind, {_FIT} fit from audited) {_rows(_Q3, 'x')}")
def q3(spark, d):
    return Q.expectations(audited(spark, d).withColumns({"record_kind": F.expr(_FLOW), "eligibility": F.expr(_FIT)}), Q.flow_rules())


def _claims(spark, d):
    e = V.entities(spark, d).select(F.col("entity").alias("id"), F.col("kind"), F.col("countries").alias("citations"))
    n = V.table(spark, d, "nation")
    src = n.select(F.col("n_name").alias("source_id"), F.when(F.col("n_nationkey") % 3 == 0, "capability-only").otherwise("active").alias("role"), (F.col("n_nationkey") % 4 != 0).alias("available"), F.col("n_regionkey").alias("group"))
    return e, src


_CLAIM = f"{V.ENTITIES}, s as (select n_name source_id, n_nationkey % 3 <> 0 and n_nationkey % 4 <> 0 act, n_regionkey g from nation), x as (select entity, source_id, g, act from (select entity, unnest(countries) c from entities) join s on c = source_id), y as (select e.entity id, e.kind, count(distinct case when act then source_id end) active, count(distinct case when act then g end) as \"groups\" from entities e left join x on x.entity = e.entity group by all)"


@query("q4_claim_support", f"with {_CLAIM} select *, \"groups\" >= case when kind = 'F' then 2 else 1 end supported from y")
def q4(spark, d):
    e, src = _claims(spark, d)
    return Q.claim_support(e, F.broadcast(src), F.when(F.col("kind") == "F", 2).otherwise(1))  # a row per nation


@query("j16_citation_chain", f"with {_CLAIM} select source_id, act active, count(*) n from x group by all")
def j16(spark, d):
    e, src = _claims(spark, d)
    x = e.select(F.explode("citations").alias("source_id")).join(F.broadcast(src), "source_id")
    return x.groupBy("source_id", ((F.col("role") == "active") & F.col("available")).alias("active")).agg(F.count(F.lit(1)).alias("n"))


@query("q5_citation_coverage", f"with {V.ENTITIES} select count(*) filter (len(countries) > 0) cited, count(*) total, floor(count(*) filter (len(countries) > 0)::double / count(*) * 100 * 10 + 0.5) / 10 pct from entities")
def q5(spark, d):
    return Q.citation_coverage(V.entities(spark, d), "countries")


BANNED = [("(?i)\\bidiot\\b", "insult"), ("(?i)\\bguarantee", "certainty"), ("AKIA[A-Z0-9]{16}", "key")]


@query("q6_banned_claim_scan", " union all ".join(f"select doc_id, 'text' field, '{n}' as \"rule\" from documents where regexp_matches(text, '{p}')" for p, n in BANNED))
def q6(spark, d):
    return Q.rule_scan(V.table(spark, d, "documents"), "doc_id", ["text"], BANNED)


#: An event as a record with records inside; those of errors say their properties only.
_RECORD = """case when event_type = 'error' then props else concat('{"z":', cast(`value` as string), ',"Props":', props, ',"owner":{"E-Mail":"u', user_id, '@example.org","more":[{"Phone Number":', event_id, ',"b":null,"B":true},"', event_type, ' said é",[]]}}') end"""


def event_records(spark, d):
    """event_id and ``record``."""
    return V.table(spark, d, "events").select("event_id", "event_type", F.expr(_RECORD).alias("record"))


@query("q6b_strings_anywhere", "select event_id, 'owner.E-Mail' path, 'address' \"rule\" from events where event_type <> 'error' union all select event_id, 'owner.more.1', 'purchase' from events where event_type = 'purchase'")
def q6b(spark, d):
    said = R.strings(R.nodes(event_records(spark, d), "event_id", "record"))
    return Q.rule_scan(said, ["event_id", "path"], ["text"], [("@[a-z]+[.]org", "address"), ("^purchase\\b", "purchase")]).drop("field")


@query("q7_forbidden_fields", "select event_id, unnest(case when event_type = 'error' then ['k'] else ['Props.k', 'owner.E-Mail', 'owner.more.0.Phone Number'] end) path from events")
def q7(spark, d):
    return R.forbidden_keys(R.nodes(event_records(spark, d), "event_id", "record"), (*R.PERSONAL_KEYS, "k"))


_CANON = """case when event_type = 'error' then replace(props, ' ', '') else concat('{"Props":', replace(props, ' ', ''), ',"owner":{"E-Mail":"u', user_id, '@example.org","more":[{"B":true,"Phone Number":', event_id, ',"b":null},"', event_type, ' said é",[]]},"z":', regexp_replace(cast("value" as varchar), '[.]0$', ''), '}') end"""


@query("f29b_canonical_hash", f"select event_id, sha256({_CANON}) h, event_type <> 'click' verified from events")
def f29b(spark, d):
    """Hashes of nested records; each record then carries its hash, those of clicks one of other content."""
    r = event_records(spark, d).withColumn("h", R.content_hash(F.col("record")))
    said = F.when(F.col("event_type") == "click", F.sha2("record", 224)).otherwise(F.col("h"))
    carried = F.concat(F.lit('{"contentHash":"'), said, F.lit('",'), F.substring("record", 2, 1 << 30))
    return R.verify_hashes(r.withColumn("record", carried), "record").select("event_id", "h", "verified")


@query("q8_history_gate", "with m as (select *, row_number() over w rn, ts < lag(ts) over w back from events window w as (partition by user_id order by event_id)) select user_id, max(case when rn = 1 then event_type end) = 'click' starts_right, count(*) = count(distinct \"value\") unique_hashes, count(*) filter (back) = 0 monotone from m group by user_id")
def q8(spark, d):
    return Q.history_gate(V.table(spark, d, "events"), "user_id", "event_id", "event_type", "click", "value", "ts")


#: Candidates: every event again, as it was, with other properties, or with other properties and a later time.
_NEXT = "select user_id, case when event_type in ('click', 'view') then props else props || ' ' end props, case when event_type = 'error' then ts + interval 400 days else ts end ts from events"


@query("q9_append_revision", f"with l as (select user_id, max(ts) t, max_by(props, (ts, event_id)) cur from events group by user_id), h as (select distinct user_id, props from events), c as ({_NEXT}) select c.user_id, c.props, c.ts, case when c.props = cur then 'no-op' when h.props is not null then 'replay' when c.ts <= t then 'backwards' else 'append' end outcome from c left join l on l.user_id = c.user_id left join h on h.user_id = c.user_id and h.props = c.props".replace("(ts, event_id)", "row(ts, event_id)"))
def q9(spark, d):
    e = V.table(spark, d, "events").select("user_id", "props", "ts", "event_id", "event_type")
    later = F.col("ts") + F.expr("interval 400 days")
    again = e.select("user_id", F.when(F.col("event_type").isin("click", "view"), F.col("props")).otherwise(F.concat("props", F.lit(" "))).alias("props"), F.when(F.col("event_type") == "error", later).otherwise(F.col("ts")).alias("ts"))
    return Q.append_revision(e, again, "user_id", "props", "ts", "event_id")


_GATES = " union all ".join(f"select '{n}: ' || rule as \"rule\", passed from ({ORACLE[k]})" for n, k in (("orders", "q1_expectations"), ("suppliers", "q2_registry_gate"), ("flows", "q3_audited_flow_gate")))


@query("q10_verification_receipt", f"select count(*) assertions, count(*) filter (not q.passed) failures, coalesce(string_agg(q.rule, '; ' order by q.rule) filter (not q.passed), '') failed, count(*) filter (not q.passed) = 0 passed from ({_GATES}) q")
def q10(spark, d):
    return Q.receipt({"orders": q1(spark, d), "suppliers": q2(spark, d), "flows": q3(spark, d)})


@query("q11_partition_check", f"with {V.ENTITIES} select kind, count(*) total, count(*) filter (len(countries) < 2) single, count(*) filter (len(countries) >= 2) multi, true partitions from entities group by kind")
def q11(spark, d):
    n = F.size("countries")
    g = V.entities(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count_if(n < 2).alias("single"), F.count_if(n >= 2).alias("multi"))
    return g.withColumn("partitions", F.col("total") == F.col("single") + F.col("multi"))


@query("q12_recompute_check", f"with {V.FLOWS}, a as (select dest, year, cast(sum(qty) as bigint) t from flows group by all), b as (select dest, year, case when year = 1999 and dest = 'NATION_5' then t + 1 else t end t from a where year > 1995) select coalesce(a.dest, b.dest) dest, coalesce(a.year, b.year) as \"year\", b.t stored, a.t recomputed from a full join b on a.dest = b.dest and a.year = b.year where a.t is distinct from b.t")
def q12(spark, d):
    a = A.totals_by(V.flows(spark, d, "dest year qty"), ["dest", "year"], "qty")
    stored = a.where("year > 1995").withColumn("total", F.when((F.col("year") == 1999) & (F.col("dest") == "NATION_5"), F.col("total") + 1).otherwise(F.col("total")))
    return Q.recompute_check(stored, a, ["dest", "year"], "total")


_Q13 = [("allowed segments", "c_mktsegment in ('BUILDING', 'MACHINERY', 'FURNITURE', 'HOUSEHOLD')"), ("named", "c_name like 'Customer#%'"), ("balance known", "c_acctbal is not null")]


@query("q13_public_boundary", _rows(_Q13, "customer"))
def q13(spark, d):
    return Q.expectations(V.table(spark, d, "customer"), {n: F.expr(c) for n, c in _Q13})


@query("q14_harm_points", f"with {V.OUTCOMES} select year, cast(sum(deaths) as bigint) deaths from outcomes where product = '2-HIGH' and month = 12 and not \"partial\" group by year")
def q14(spark, d):
    return V.outcomes(spark, d).where("product = '2-HIGH' and month = 12 and not partial").groupBy("year").agg(F.sum("deaths").alias("deaths")).orderBy("year")


_Q15 = [("kebab id", "regexp_matches(lower(p_brand), '^[a-z0-9#]+$')"), ("known focus", "p_type in ('ECONOMY', 'SMALL', 'LARGE', 'MEDIUM')"), ("two keywords", "len(string_split(p_name, ' ')) >= 2")]


@query("q15_registry_validate", _rows(_Q15, "part"))
def q15(spark, d):
    rules = {"kebab id": F.lower("p_brand").rlike("^[a-z0-9#]+$"), "known focus": F.col("p_type").isin("ECONOMY", "SMALL", "LARGE", "MEDIUM"), "two keywords": F.size(F.split("p_name", " ")) >= 2}
    return Q.expectations(V.table(spark, d, "part"), rules)


# --- streams


def events_stream(spark, d, files=4):
    return I.stream_table(spark, d, "events", files).withColumn("ts", F.col("ts").cast("timestamp"))


_SUMMARY = """concat('{"schema_version":"summary/v1","producer":"', case when user_id % 7 = 0 then 'other' else 'monitor' end, '","data_classification":"PRIVATE_ANALYST_REVIEW","review_status":"HUMAN_REVIEW_REQUIRED","publication_eligible":', case when user_id % 11 = 0 then '"false"' else 'false' end,
  ',"intended_consumers":["analysts"],"window":{"start":"2024-01-01T00:00:00Z","end":"', case when user_id % 13 = 0 then '2023-12-31T00:00:00Z' else '2024-02-01T00:00:00.5Z' end, '","complete":true', case when user_id % 17 = 0 then ',"note":1' else '' end,
  '},"sampling_frame":{"surface":"SURFACE","universal_telegram_coverage":false,"raw_messages_included":false,"exact_iocs_included":false,"source_identifiers_included":false},"coverage":{"messages_observed":', n, ',"messages_flagged":', errors, ',"sources_observed":', kinds,
  ',"collection_errors":', case when user_id % 5 = 0 then '1.5' else '0' end, '},"detections":{"status":"', case when n >= 60 then 'AVAILABLE_FOR_REVIEW' else 'INSUFFICIENT_COVERAGE' end, '","minimum_messages":60,"minimum_sources":2,"tier_counts":{', case when n >= 60 or user_id % 3 = 0 then concat('"', case when user_id % 19 = 0 then 'SURE' else 'WATCH' end, '":', errors) else '' end,
  '},"family_counts":{', case when user_id % 23 = 0 then '"-bad":1' else '' end, '}},"limitations":["unverified"]}')""".replace("SURFACE", SURFACE)
_MONITORED = "select user_id, count(*) n, count(*) filter (where event_type = 'error') errors, count(distinct event_type) kinds from events group by user_id"
_WRONG = [
    ("producer: unknown", "user_id % 7 = 0"), ("publication_eligible: not false", "user_id % 11 = 0"), ("window: end doesn't follow start", "user_id % 13 = 0"), ("window: keys", "user_id % 17 = 0"), ("coverage.collection_errors: no count", "user_id % 5 = 0"),
    ("detections.tier_counts: unknown name", "user_id % 19 = 0 and (n >= 60 or user_id % 3 = 0)"), ("detections.family_counts: unknown name", "user_id % 23 = 0"), ("detections: counts not suppressed", "n < 60 and (user_id % 3 = 0 or user_id % 23 = 0)"), ("detections: coverage too small", "n >= 60 and kinds < 2"),
]


def written(spark, df, name):
    """``df`` as a table of files, to be read as a stream."""
    at = new_path(spark, name)
    df.write.parquet(f"{at}/{name}.parquet")
    clear_at_exit(spark, at)
    return at


@query("i1_firewall", "with s as (" + _MONITORED + "), f as (" + " union all ".join(f"""select user_id, '{r.replace("'", "''")}' reason from s where {c}""" for r, c in _WRONG) + ") select user_id, reason from f union all select user_id, 'accepted' from s where user_id not in (select user_id from f)")
def i1(spark, d):
    e = V.table(spark, d, "events")
    s = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("event_type").alias("kinds"))
    at = written(spark, s.select("user_id", F.expr(_SUMMARY).alias("record")), "summaries")
    accepted, rejects = P.screen(I.stream_table(spark, at, "summaries"), "record", Contract("summary/v1", "monitor", "analysts"), f"{at}/state")
    return accepted.read().select("user_id", F.lit("accepted").alias("reason")).unionByName(rejects.read().select("user_id", "reason"))


@query("i2_coverage_suppression", "with g as (select user_id, count(*) messages, count(distinct event_type) sources, count(*) filter (event_type = 'error') n from events group by user_id) select user_id, messages, sources, case when messages >= 60 and sources >= 5 then n end n, case when messages >= 60 and sources >= 5 then 'sufficient' else 'insufficient' end status from g")
def i2(spark, d):
    g = V.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("messages"), F.countDistinct("event_type").alias("sources"), F.count_if(F.col("event_type") == "error").alias("n"))
    return I.suppressed(g, "n", "messages", "sources", 60, 5)


@query("i3_idempotent_import", "with c as (select *, props is distinct from lag(props) over (partition by user_id order by ts, event_id) changed from events) select user_id, count(*) filter (changed) snapshots, count(*) filter (changed) receipts, max_by(sha256(props), row(ts, event_id)) \"current\" from c group by user_id")
def i3(spark, d):
    """The events of each user as records of one source, imported; then once more by the same stream, which has nothing left to do."""
    state = new_path(spark, "import")
    clear_at_exit(spark, state)
    for _ in range(2):
        snapshots, receipts = P.import_snapshots(events_stream(spark, d, None), "user_id", F.col("props"), ["ts", "event_id"], state)
    kept = snapshots.read().groupBy("user_id").agg(F.count(F.lit(1)).alias("snapshots"), F.max_by("sha256", F.struct("imported_at", "at")).alias("current"))
    return kept.join(receipts.read().groupBy("user_id").agg(F.count(F.lit(1)).alias("receipts")), "user_id", "left")


@query("i4_hourly_snapshot", "with w as (select cast(floor(epoch(ts) / 3600) as bigint) w, arg_max(\"value\", ts) latest, count(*) n from events group by 1) select w * 3600 hour_s, latest, n from w where (w + 1) * 3600 <= (select epoch(max(ts)) - 600 from events)")
def i4(spark, d):
    return I.drain(I.hourly_snapshot(events_stream(spark, d, None), "ts", "value"), "snapshot").select(F.unix_timestamp("hour").alias("hour_s"), "latest", "n")


@query("i5_receipt_ledger", "select event_id, sha256(cast(event_id as varchar) || chr(31) || event_type) receipt from events")
def i5(spark, d):
    return I.drain(events_stream(spark, d).select("event_id", C.content_key(F.col("event_id"), F.col("event_type")).alias("receipt")), "ledger")


@query("i6_observation_stream", f"with then_ as (with {_seen(None, f'(select page_id, url, {_THEN} html from pages)')} select keyword, fingerprint from seen), now_ as (with {_seen(None)} select keyword, fingerprint from seen), t as (select count(*) n, count(distinct fingerprint) u from then_), n as (select count(*) n, count(distinct case when fingerprint not in (select fingerprint from then_) then fingerprint end) u from now_) select 'first' run, n found, n - u suppressed from t union all select 'second', n, n - u from n")
def i6(spark, d):
    """Two runs over the pages; those of one host said another word in the first."""
    state = new_path(spark, "observations")
    clear_at_exit(spark, state)
    pages = I.stream_table(spark, d, "pages").select("page_id", "url", "html")
    find = lambda df: N.keyword_observations(df, KEYWORDS)
    P.observe(pages.withColumn("html", F.expr(_THEN)), find, state, "first")
    _, counts = P.observe(pages, find, state, "second")
    return counts.read().groupBy("run").agg(F.sum("found").alias("found"), F.sum("suppressed").alias("suppressed"))


@query("i7_weekly_rollup", "with w as (select cast(floor(epoch(ts) / 604800) as bigint) w, event_type, count(*) n, cast(sum(floor(\"value\")) as bigint) total from events group by all) select w * 604800 week_s, event_type, n, total from w where (w + 1) * 604800 <= (select epoch(max(ts)) - 86400 from events)")
def i7(spark, d):
    e = events_stream(spark, d, None).withColumn("v", F.floor("value"))
    return I.drain(I.weekly_rollup(e, "ts", ["event_type"], "v"), "weekly").select(F.unix_timestamp("week").alias("week_s"), "event_type", "n", "total")


@query("i8_changed_only", "select c_custkey, c_mktsegment from customer where c_acctbal < 0 or c_mktsegment = 'FURNITURE'")
def i8(spark, d):
    """Published before: all customers but those of one segment, with another segment for those in debt."""
    now = V.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    then = now.where("c_mktsegment <> 'FURNITURE'").withColumn("c_mktsegment", F.when(F.col("c_acctbal") < 0, "OLD").otherwise(F.col("c_mktsegment")))
    return I.changed_only(now, then, "c_custkey", ["c_mktsegment"]).select("c_custkey", "c_mktsegment")
