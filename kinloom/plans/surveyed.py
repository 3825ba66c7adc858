"""One query for each surveyed operator, over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.functions.names import literal_text, record_name, schema_term
from kinloom.operators import names
from kinloom.operators import triples as t3
from kinloom.operators import vectors as vec
from kinloom.operators.linking import normalize_key
from kinloom.operators.rejects import load_statements
from kinloom.plans.views import Views, sql
from kinloom.session import Scratch
from kinloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, body: str | None = None, *views: str):
    def keep(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if body:
            SQL[name] = sql(body, *views)
        return f
    return keep


def define(name: str, f: Callable[[Views], DataFrame], body: str | None = None, *views: str) -> None:
    query(name, body, *views)(f)


def r6(c, alias: str):
    return F.round(c, 6).alias(alias)


def as_rel(attributes: DataFrame) -> DataFrame:
    return attributes.select(F.col("e").alias("h"), F.col("a").alias("r"), F.col("v").alias("t"))


def as_attr(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("h").alias("e"), F.col("r").alias("a"), F.col("t").alias("v"))


# filters
define("predicate_pattern_filter", lambda v: t3.predicate_pattern(v.web, "Date Published"), "select * from web where contains(regexp_replace(lower(r),'[^a-z0-9]','','g'),'datepublished')", "web")
define("predicate_histogram_topn", lambda v: t3.predicate_histogram(v.web, 20), "select r,count(*) n from web group by r order by n desc, r limit 20", "web")
define("type_filter", lambda v: t3.of_type(v.rel1, "inRegion", "r1"), "select * from rel1 where h in (select h from rel1 where r='inRegion' and t='r1')", "rel1")
define("exclude_predicates", lambda v: t3.without_predicates(v.rel1, ["inNation"]), "select * from rel1 where r <> 'inNation'", "rel1")
define("exclude_predicate_parts", lambda v: t3.without_predicates(v.web, parts=["keywords", "sku"]), "select * from web where not contains(lower(r),'keywords') and not contains(lower(r),'sku')", "web")
define("mask_literals", lambda v: t3.mask_values(v.attr2, v.table("part").where("p_size > 40").select(F.col("p_name").alias("v"))), "select * from attr2 where v not in (select p_name from part where p_size>40)", "attr2")
define("min_predicate_count", lambda v: t3.min_predicate_count(v.rel2, 100), "select * from rel2 where r in (select r from rel2 group by r having count(*)>=100)", "rel2")
define("min_entity_triples", lambda v: t3.min_entity_triples(v.links, v.rel1, 2), "select e1,e2 from links where e1 in (select h from rel1 group by h having count(*)>=2)", "links", "rel1")
define("property_frequency_filter", lambda v: t3.property_frequency(as_rel(v.attr2), v.spark.createDataFrame([("label", "short name"), ("brand", "image"), ("type", "kind")], "r string, label string"), 3487, ["image"], ["short name"]),
       "select e h,a r,v t from attr2 where a<>'brand' and (a='label' or (select count(*) from attr2 b where b.a=attr2.a)>3487)", "attr2")
define("remove_unlinked", lambda v: t3.both_ends_in(v.place, v.links.select(F.col("e1").alias("e")).unionByName(v.table("nation").select(v.key("n", "n_nationkey").alias("e")))),
       "with e as (select e1 e from links union select concat('n',n_nationkey) from nation) select * from place where h in (select e from e) and t in (select e from e)", "links", "place")
define("links_without_triples", lambda v: t3.links_with_triples(v.links, v.rel1, v.rel2), "select distinct e1,e2 from links where (e1 in (select h from rel1) or e1 in (select t from rel1)) and (e2 in (select h from rel2) or e2 in (select t from rel2))", "links", "rel1", "rel2")


@query("fixpoint_prune", "select h,r,t from a where false", )
def fixpoint_prune(v: Views) -> DataFrame:
    """Edges between linked entities after pruning in turn until sizes stay."""
    a = v.table("orders").select(v.key("c", "o_custkey").alias("h"), F.lit("same").alias("r"), F.concat(F.lit("c"), ((F.col("o_custkey") * 7) % 150).cast("string")).alias("t"))
    b = v.rel2.where("r = 'suppliedBy'").select(F.col("t").alias("h"), "r", F.concat(F.lit("s"), (F.substring("h", 2, 9).cast("bigint") % 100).cast("string")).alias("t"))
    return t3.prune_to_links(Scratch(v.spark, "prune"), v.links.select("e1", "e2"), a, b)[1]


del SQL["fixpoint_prune"]
define("head_reachable", lambda v: t3.head_reachable(v.rel1), "select * from rel1 where t in (select h from rel1)", "rel1")
define("clear_attributes", lambda v: t3.clear_attributes(v.attr2, 10).select("e", "a", "v"),
       r"""with x as (select e,a,trim(regexp_replace(regexp_replace(v,'[.(),_\-]',' ','g'),'\s+',' ','g')) v from attr2 where a in (select a from attr2 group by a having count(*)>=10) and not contains(lower(v),'http')) select * from x where v<>''""", "attr2")
define("popular_attributes", lambda v: t3.popular_attributes(v.attr2, 0.7), "with c as (select a,count(*) n from attr2 group by a), k as (select *,row_number() over (order by n desc,a) k,count(*) over () m from c) select a,n from k where k<=floor(m*0.7)", "attr2")
define("attribute_onehot", lambda v: t3.attribute_onehot(v.attr2), "with c as (select a,count(distinct e) n from attr2 group by a), k as (select *,row_number() over (order by n desc,a) k,count(*) over () m from c) select distinct e,k-1 idx,1.0::double val from attr2 join k using(a) where k<=floor(m*0.7)", "attr2")
define("language_filter", lambda v: t3.language_filter(as_attr(v.web), "en"), """select h e,r a,t v from web where regexp_extract(t,'"@([A-Za-z-]+)$',1) in ('','en')""", "web")
define("description_attribute", lambda v: t3.first_description(as_attr(v.web)), "select h e,min(t) v from web where contains(r,'escription') group by h", "web")
define("attr_rel_split", lambda v: t3.attr_rel_split(v.web), """select h,r,t,case when starts_with(t,'"') then 'attr' else 'rel' end kind from web""", "web")

# links and joins
define("key_links", lambda v: v.table("customer").select(F.col("c_nationkey").alias("k"), v.key("c", "c_custkey").alias("e1")).distinct().join(v.table("supplier").select(F.col("s_nationkey").alias("k"), v.key("s", "s_suppkey").alias("e2")).distinct(), "k").groupBy("e1").agg(F.count(F.lit(1)).alias("n")),
       "select concat('c',c_custkey) e1,count(*) n from customer join supplier on c_nationkey=s_nationkey group by 1")


def _codes(rows: DataFrame, key, code) -> DataFrame:
    return rows.select(key.alias("e"), code.alias("key"))


@query("key_link_prefix", "with a as (select concat('c',c_custkey) e1,concat('key00',lpad(c_custkey::varchar,4,'0')) k1 from customer), b as (select concat('o',o_orderkey) e2,concat('key00',lpad((o_orderkey%9999)::varchar,4,'0'),'x') k2 from orders) select e1,e2,9::int min_len from a join b on k1=left(k2,9)")
def key_link_prefix(v: Views) -> DataFrame:
    a = _codes(v.table("customer"), v.key("c", "c_custkey"), F.concat(F.lit("key00"), F.lpad(F.col("c_custkey").cast("string"), 4, "0")))
    b = _codes(v.table("orders"), v.key("o", "o_orderkey"), F.concat(F.lit("key00"), F.lpad((F.col("o_orderkey") % 9999).cast("string"), 4, "0"), F.lit("x")))
    return t3.prefix_links(a, b)


define("key_link_unmatched", lambda v: v.table("orders").select(F.col("o_custkey").alias("k")).distinct().join(v.table("supplier").select(F.col("s_suppkey").alias("k")), "k", "left_anti"), "select distinct o_custkey k from orders where o_custkey not in (select s_suppkey from supplier)")
define("canonical_merge_map", lambda v: t3.merge_map(v.table("part").select(v.key("p", "p_partkey").alias("e"), F.col("p_name").alias("key"))), "select e,target from (select concat('p',p_partkey) e,min(concat('p',p_partkey)) over (partition by p_name) target from part) where e<>target")
define("apply_merge_map", lambda v: t3.apply_merge(v.rel2, t3.merge_map(v.table("part").select(v.key("p", "p_partkey").alias("e"), F.col("p_name").alias("key")))),
       "with m as (select concat('p',p_partkey) e,min(concat('p',p_partkey)) over (partition by p_name) g from part) select coalesce(a.g,h) h,r,coalesce(b.g,t) t from rel2 left join m a on a.e=h left join m b on b.e=t", "rel2")
define("dedupe_links", lambda v: v.table("read_links").select("wdc_iri", "wikidata_uri").distinct(), "select distinct wdc_iri,wikidata_uri from read_links")
define("reverse_pair", lambda v: v.links.select(F.col("e2").alias("e1"), F.col("e1").alias("e2")), "select e2 e1,e1 e2 from links", "links")
define("swap_relation_triples", lambda v: t3.swap_relations(v.links, v.rel1, "e1", "e2"), "select e2 h,r,t from rel1 join links on h=e1 union select h,r,e2 from rel1 join links on t=e1", "links", "rel1")
define("swap_attribute_triples", lambda v: t3.swap_attributes(v.links, v.attr1, "e1", "e2"), "select distinct e2 e,a,v from attr1 join links on e=e1", "links", "attr1")
define("weighted_swap_triples", lambda v: t3.swap_relations(v.links, v.rel1, "e1", "e2").withColumn("w", F.lit(0.5)), "select *,0.5::double w from (select e2 h,r,t from rel1 join links on h=e1 union select h,r,e2 from rel1 join links on t=e1)", "links", "rel1")
PAIRS = "pairs as (select * from (values ('placedBy','suppliedBy',0.9::double),('inNation','locatedIn',0.8),('inRegion','partOf',0.6)) x(p1,p2,w))"


def _pairs(v: Views) -> DataFrame:
    return v.spark.createDataFrame([("placedBy", "suppliedBy", 0.9), ("inNation", "locatedIn", 0.8), ("inRegion", "partOf", 0.6)], "p1 string, p2 string, w double")


define("predicate_swap", lambda v: t3.predicate_swap(v.rel1, _pairs(v)), f"with {PAIRS} select h,p2 r,t,w from rel1 join pairs on r=p1", "rel1")
define("weighted_triples", lambda v: t3.weighted(v.rel1, _pairs(v).where("p1 <> 'inRegion'")).withColumn("w", F.round("w", 6)), "select h,r,t,round(case r when 'placedBy' then 1-0.1*0.5/0.2 when 'inNation' then 0.5 else 0.2 end,6)::double w from rel1", "rel1")
define("enhance_triples", lambda v: t3.enhance(v.links.select("e1", "e2").unionByName(v.table("nation").select(v.key("n", "n_nationkey").alias("e1"), v.key("n", "n_nationkey").alias("e2"))), v.rel1, v.rel2),
       "with m as (select e1,e2 from links union select concat('n',n_nationkey),concat('n',n_nationkey) from nation) select distinct a.e2 h,r,b.e2 t from rel1 join m a on h=a.e1 join m b on t=b.e1 where not exists (select 1 from rel2 x where x.h=a.e2 and x.t=b.e2)", "links", "rel1", "rel2")
define("rsn_expansion", lambda v: t3.expand(v.links, v.rel1), "with m as (select e1 x,e2 y from links union select e2,e1 from links), f as (select h,r,t,a.y hy,b.y ty from rel1 left join m a on a.x=h left join m b on b.x=t) select h,r,t from f union select hy,r,t from f where hy is not null union select h,r,ty from f where ty is not null union select hy,r,ty from f where hy is not null and ty is not null", "links", "rel1")
define("aligned_neighbours", lambda v: t3.one_hop(v.rel1).join(v.links.select(F.col("e1").alias("b")), "b", "left_semi").select("a", "b"), "select distinct a,b from (select h a,t b from rel1 union select t,h from rel1) where a<>b and b in (select e1 from links)", "links", "rel1")
define("two_step_paths", lambda v: t3.two_step_paths(v.rel1), "with f as (select h,r,count(*) n from rel1 group by 1,2), l as (select rel1.*,n from rel1 join f using(h,r)) select x.r rx,y.r ry,z.r r,x.n*y.n w from l x join l y on x.t=y.h join rel1 z on z.h=x.h and z.t=y.t where x.n*y.n<101", "rel1")
define("two_hop_patterns", lambda v: t3.two_hop_patterns(v.rel1, 1), "with p as (select x.h h,x.r rx,y.r ry,y.t t from rel1 x join rel1 y on x.t=y.h where x.h<>y.t and not exists (select 1 from rel1 z where z.h=x.h and z.t=y.t)), c as (select rx,ry,row_number() over (order by count(*) desc,rx,ry) k from p group by rx,ry) select distinct h,concat(rx,'+',ry) pattern,t from p join c using(rx,ry) where k>1", "rel1")
define("threshold_pairs_semi", lambda v: v.rel1.join(v.links.select(F.col("e1").alias("h")), "h", "left_anti").select("h", "r", "t"), "select * from rel1 where h not in (select e1 from links)", "links", "rel1")

# sets, order, ids
define("set_operations", lambda v: v.rel1.select("t").distinct().intersect(v.rel2.select("t")).unionByName(v.rel1.select("t").exceptAll(v.rel1.select("t")).distinct()), "select t from rel1 intersect select t from rel2", "rel1", "rel2")
define("dict_merge", lambda v: v.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("a")).join(v.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("b")), "k", "full").select("k", F.coalesce("b", "a").alias("v")),
       "select coalesce(c_custkey,s_suppkey) k,coalesce(s_name,c_name) v from customer full join supplier on c_custkey=s_suppkey")


def ordered(rows: DataFrame) -> DataFrame:
    """(e, n, rank): by occurrences, then name, both falling; ranks by a global window, for listings of small sets."""
    return rows.groupBy("e").agg(F.count(F.lit(1)).alias("n"))


define("element_frequency_order", lambda v: ordered(v.rel2.select(F.explode(F.array("h", "t")).alias("e"))), "select e,count(*) n from (select h e from rel2 union all select t from rel2) group by e", "rel2")


@query("mapping_ids", "with a as (select e,row_number() over (order by count(*) desc,e desc)-1 k,count(*) over () n from (select h e from place union all select t from place) group by e), b as (select e,row_number() over (order by count(*) desc,e desc)-1 k,count(*) over () n from (select h e from rel2 union all select t from rel2) group by e), m as (select least((select count(*) from a),(select count(*) from b)) m) select 1::bigint g,e element,case when k<m then 2*k else m+k end id from a,m union all select 2,e,case when k<m then 2*k+1 else m+k end from b,m", "place", "rel2")
def mapping_ids(v: Views) -> DataFrame:
    from kinloom.operators.linking import mapping_ids as ids

    one, two = ids(v.spark, *(r.select(F.explode(F.array("h", "t")).alias("element")) for r in (v.place, v.rel2)))
    return one.select(F.lit(1).cast("bigint").alias("g"), "element", "id").unionByName(two.select(F.lit(2).cast("bigint").alias("g"), "element", "id"))


@query("sharing_ids", "with m as (select e1,e2 from links), a as (select e,row_number() over (order by count(*) desc,e desc)-1 k from (select h e from place union all select t from place) group by e), r2 as (select h e from rel2 union all select t from rel2), b as (select e,row_number() over (order by count(*) desc,e desc)-1 k from r2 where e not in (select e2 from m) group by e), z as (select least((select count(*) from a),(select count(*) from b)) m), ia as (select e,case when k<m then 2*k else m+k end id from a,z), ib as (select e,case when k<m then 2*k+1 else m+k end id from b,z) select e element,id from ib union all select distinct e2,ia.id from m join ia on ia.e=m.e1 where e2 in (select e from r2)", "links", "place", "rel2")
def sharing_ids(v: Views) -> DataFrame:
    """(element, id) of graph 2: linked elements take their partner's id, the others interleave with graph 1."""
    from kinloom.operators.linking import mapping_ids as ids

    elements = v.rel2.select(F.explode(F.array("h", "t")).alias("element"))
    alone = elements.join(v.links.select(F.col("e2").alias("element")), "element", "left_anti")
    one, two = ids(v.spark, v.place.select(F.explode(F.array("h", "t")).alias("element")), alone)
    last = v.links.groupBy("e2").agg(F.max_by("e1", "pos").alias("e1"))
    shared = last.join(elements.select(F.col("element").alias("e2")).distinct(), "e2", "left_semi").join(one.withColumnRenamed("element", "e1"), "e1").select(F.col("e2").alias("element"), "id")
    return two.unionByName(shared)


@query("triples_to_ids", "with a as (select e,row_number() over (order by count(*) desc,e desc)-1 id from (select h e from place union all select t from place) group by e) select x.id h,r,y.id t from place join a x on x.e=h join a y on y.e=t", "place")
def triples_to_ids(v: Views) -> DataFrame:
    from kinloom.operators.linking import ranked

    ids = ranked(v.spark, v.place.select(F.explode(F.array("h", "t")).alias("element")), Scratch(v.spark, "ids"))
    x = v.place.join(ids.select(F.col("element").alias("h"), F.col("rank").alias("hi")), "h").join(ids.select(F.col("element").alias("t"), F.col("rank").alias("ti")), "t")
    return x.select(F.col("hi").alias("h"), "r", F.col("ti").alias("t"))


define("five_fold_split", lambda v: t3.folds(v.links), "with f as (select fold,e1,e2,row_number() over (partition by fold order by md5(concat(fold,'|',e1,'|',e2)),e1,e2) k,count(*) over (partition by fold) n from links, range(1,6) r(fold)) select fold,e1,e2,case when k<=floor(n*0.7) then 'train' when k<=floor(n*0.7)+floor(n*0.2) then 'valid' else 'test' end part from f", "links")
define("chunk_tasks", lambda v: v.links.select("e1", F.least(F.floor(F.col("pos") / 30), F.lit(2)).cast("bigint").alias("task")), "select e1,least(pos//30,2) task from links", "links")
define("value_length_histogram", lambda v: v.web.groupBy(F.least(F.floor(F.length("t") / 10), F.lit(10)).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "select least(length(t)//10,10) bucket,count(*) n from web group by 1", "web")

# counts and features
define("predicate_counts", lambda v: v.web.groupBy("r").agg(F.count(F.lit(1)).alias("n")), "select r,count(*) n from web group by r", "web")
define("distinct_values", lambda v: v.web.agg(F.countDistinct("t").alias("n_raw"), F.countDistinct("h").alias("n_iris"), F.countDistinct(F.lower(F.trim("t"))).alias("n_norm")), "select count(distinct t) n_raw,count(distinct h) n_iris,count(distinct lower(trim(t))) n_norm from web", "web")
define("value_multimap", lambda v: v.table("part").groupBy("p_name").agg(F.array_join(F.sort_array(F.collect_set(v.key("p", "p_partkey"))), ",").alias("ids")), "select p_name,string_agg(concat('p',p_partkey),',' order by concat('p',p_partkey)) ids from part group by 1")
define("entity_degree", lambda v: t3.degrees(v.rel2), "select e,count(*) deg from (select h e from rel2 union all select t from rel2) group by e", "rel2")
define("pair_degree_buckets", lambda v: t3.pair_degree_buckets(v.links, t3.degrees(v.rel1), t3.degrees(v.rel2), [1, 10, 100, 300]),
       "with a as (select e,count(*) d from (select h e from rel1 union all select t from rel1) group by e), b as (select e,count(*) d from (select h e from rel2 union all select t from rel2) group by e), m as (select (coalesce(a.d,0)+coalesce(b.d,0))/2 m from links left join a on a.e=e1 left join b on b.e=e2) select (m>=1)::bigint+(m>=10)::bigint+(m>=100)::bigint+(m>=300)::bigint bucket,count(*) n from m group by 1", "links", "rel1", "rel2")
define("relation_functionality", lambda v: t3.functionality(v.rel1).select("r", r6(F.col("fun"), "fun"), r6(F.col("ifun"), "ifun")), "select r,round(count(distinct h)/count(*),6) fun,round(count(distinct t)/count(*),6) ifun from rel1 group by r", "rel1")
define("weighted_adjacency", lambda v: t3.weighted_adjacency(v.place).select("a", "b", r6(F.col("w"), "w")), "with f as (select r,count(distinct h)/count(*) fun,count(distinct t)/count(*) ifun from place group by r), u as (select h a,t b,greatest(ifun,0.3) w from place join f using(r) where h<>t union all select t,h,greatest(fun,0.3) from place join f using(r) where h<>t) select a,b,round(sum(w),6) w from u group by 1,2", "place")
define("undirected_one_hop", lambda v: t3.one_hop(v.rel1), "select h a,t b from rel1 where h<>t union select t,h from rel1 where h<>t", "rel1")
define("two_hop_neighbors", lambda v: t3.two_hop(v.rel1),
       "with n as (select h a,t b from rel1 union select t,h from rel1) select distinct x.a,y.b from n x join n y on x.b=y.a where x.a<>y.b and not exists (select 1 from n z where z.a=x.a and z.b=y.b)", "rel1")
ADJ = "adj as (select a,b,1.0::double w from (select h a,t b from place union select t,h from place))"
define("normalized_adjacency", lambda v: t3.normalized(t3.one_hop(v.place).withColumn("w", F.lit(1.0))).select("a", "b", r6(F.col("w"), "w")), f"with {ADJ}, x as (select * from adj union all select distinct a,a,1.0 from adj), d as (select a,sum(w) d from x group by a) select x.a,x.b,round(w/sqrt(p.d)/sqrt(q.d),6) w from x join d p on p.a=x.a join d q on q.a=x.b", "place")
define("row_normalized_adjacency", lambda v: t3.row_normalized(t3.one_hop(v.place).withColumn("w", F.lit(1.0))).select("a", "b", r6(F.col("w"), "w")), f"with {ADJ} select a,b,round(w/sum(w) over (partition by a),6) w from adj", "place")
define("top_relation_adjacency", lambda v: t3.top_relations(v.rel1, 2), "with k as (select r,row_number() over (order by count(*) desc,r)-1 idx from rel1 group by r) select idx,h,t from rel1 join k using(r) where idx<2", "rel1")
define("relation_incidence", lambda v: t3.incidence(v.rel1), "select r,h e,'head' role from rel1 union select r,t,'tail' from rel1", "rel1")
define("degree_graph", lambda v: t3.degree_graph(v.place).select("h", "t", r6(F.col("w"), "w")), "with d as (select e,count(*)+1 d from (select h e from place union all select t from place) group by e) select h,t,round(1/sqrt(a.d)/sqrt(b.d),6) w from (select distinct h,t from place where h<>t) join d a on a.e=h join d b on b.e=t", "place")
define("attribute_cooccurrence", lambda v: t3.cooccurrence(v.attr1), "with x as (select distinct e,a from attr1) select x.a a1,y.a a2,count(*) n from x join x y on x.e=y.e and x.a<y.a group by 1,2", "attr1")
define("triple_weights", lambda v: t3.triple_weights(v.rel1), "with n as (select h,count(*) n from rel1 group by h), m as (select ceil(avg(n)) m from n) select x.h,r,t,case when n.n<=m then 2 else 1 end::bigint w from rel1 x left join n on n.h=x.t, m", "rel1")


def _rank_vectors(v: Views) -> DataFrame:
    base = v.table("embeddings").select(F.col("label").alias("a"), F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "x"))
    return base.groupBy("a", "p").agg(r6(F.avg("x"), "m"))


define("attribute_mean_vectors", _rank_vectors, "select label a,(p-1)::int p,round(avg(embedding[p]::double),6) m from embeddings, range(1,65) r(p) group by 1,2")
define("attribute_sum_vectors", lambda v: v.table("embeddings").select(F.col("label").alias("a"), F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "x")).groupBy("a", "p").agg(r6(F.sum("x"), "m")), "select label a,(p-1)::int p,round(sum(embedding[p]::double),6) m from embeddings, range(1,65) r(p) group by 1,2")


def majority(obs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): the most frequent value of each key, the smallest of equals."""
    counts = obs.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), value)).alias("b")).select(key, f"b.{value}", (-F.col("b.m")).alias("n"))


define("majority_vote", lambda v: majority(v.obs, "k", "v"), "select k,v,n from (select k,v,count(*) n,row_number() over (partition by k order by count(*) desc,v) x from obs group by k,v) where x=1", "obs")
define("numeric_truth_mean", lambda v: v.table("lineitem").groupBy(F.col("l_partkey").alias("k")).agg(r6(F.avg("l_quantity"), "v")), "select l_partkey k,round(avg(l_quantity),6) v from lineitem group by 1")
define("value_share_histogram", lambda v: majority(v.obs, "k", "v").join(v.obs.groupBy("k").agg(F.count(F.lit(1)).alias("m")), "k").groupBy(F.floor(F.col("n") * 5 / F.col("m")).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n_keys")),
       "with c as (select k,v,count(*) n from obs group by k,v), m as (select k,max(n) n,sum(n) m from c group by k) select floor(n*5/m)::bigint bucket,count(*) n_keys from m group by 1", "obs")

# extraction
BFS = "with s as (select distinct concat('o',o_orderkey) e from orders where o_orderkey%97=0), f0 as (select * from rel1 where h in (select e from s)), f1 as (select * from rel1 where h in (select t from f0) and h not in (select e from s)), f2 as (select * from rel1 where h in (select t from f1) and h not in (select t from f0) and h not in (select e from s)) "


def _bfs(depth: int):
    return lambda v: t3.bfs(Scratch(v.spark, "bfs"), v.rel1, v.table("orders").where("o_orderkey % 97 = 0").select(v.key("o", "o_orderkey").alias("e")), depth)


for _d in (0, 1, 2):
    define(f"bfs_extract_{_d}", _bfs(_d), BFS + " union all ".join(f"select * from f{i}" for i in range(_d + 1)), "rel1")
define("class_closure", lambda v: t3.closure(Scratch(v.spark, "closure"), v.place.select(F.col("h").alias("sub"), F.col("t").alias("sup")), v.spark.createDataFrame([("r1",)], "e string")), "select 'r1' e union select h from place where t='r1' union select h from place where t in (select h from place where t='r1')", "place")
define("collected_uris", lambda v: v.rel1.select(F.explode(F.array("h", "r", "t")).alias("uri")).distinct(), "select h uri from rel1 union select r from rel1 union select t from rel1", "rel1")
define("negative_sampling", lambda v: t3.negatives(v.place, v.table("nation").select(F.col("n_nationkey").cast("bigint").alias("idx"), v.key("n", "n_nationkey").alias("e")), 2, 4),
       "with e as (select n_nationkey idx,concat('n',n_nationkey) e from nation), x as (select h,r,t,i,('0x'||substring(md5(concat(h,'|',r,'|',t,'|',i)),1,8))::bigint d from place, range(0,8) g(i)), y as (select h,r,t,i,case when d%2=0 then e else h end nh,case when d%2=0 then t else e end nt from x join e on idx=(d//2)%25), z as (select *,row_number() over (partition by h,r,t order by i) k from y where not exists (select 1 from place p where p.h=y.nh and p.r=y.r and p.t=y.nt)) select h,r,t,nh,nt from z where k<=2", "place")
define("attribute_negatives", lambda v: t3.negatives(as_rel(v.attr1.where("a = 'segment'")), v.table("nation").select(F.col("n_nationkey").cast("bigint").alias("idx"), v.key("n", "n_nationkey").alias("e")), 1, 4).where("nt = t").select("h", "r", "t", "nh"), None)
define("labelled_batches", lambda v: v.place.withColumn("y", F.lit(1).cast("bigint")).unionByName(v.place.select(F.col("t").alias("h"), "r", F.col("h").alias("t"), F.lit(-1).cast("bigint").alias("y"))), "select *,1::bigint y from place union all select t,r,h,-1 from place", "place")

# text functions
define("local_name", lambda v: v.table("write_prop_stats").select("predicate", F.regexp_replace(F.element_at(F.split("predicate", "/"), -1), "_", " ").alias("name")).distinct(), "select distinct predicate,replace(list_extract(string_split(predicate,'/'),-1),'_',' ') as name from write_prop_stats")
define("attre_value_clean", lambda v: v.table("part").select("p_partkey", F.translate(F.translate(F.rtrim(F.split("p_name", r"\(")[0]), ".(),", ""), "_-", "  ").alias("v")), "select p_partkey,translate(translate(rtrim(string_split(p_name,'(')[1]),'.(),',''),'_-','  ') v from part")
define("header_normalize", lambda v: v.table("prop_catalog").select("prop", F.regexp_replace(F.lower(F.trim("col_name")), " ", "").alias("header")), "select prop,replace(lower(trim(col_name)),' ','') header from prop_catalog")
define("country_code", lambda v: v.table("nation").select("n_name", F.when(F.lower(F.substring("n_name", 1, 2)).isin("gx", "uk"), "gb").otherwise(F.lower(F.substring("n_name", 1, 2))).alias("code")), "select n_name,case when lower(left(n_name,2)) in ('gx','uk') then 'gb' else lower(left(n_name,2)) end code from nation")
define("curie_normalize", lambda v: v.table("write_prop_stats").select("predicate", F.when(F.col("predicate").rlike("^[Qq][0-9]+$"), F.concat(F.lit("wd:"), "predicate")).when(F.col("predicate").rlike("^[Pp][0-9]+$"), F.concat(F.lit("wdt:"), "predicate")).when(F.col("predicate").rlike("^https?://"), F.concat(F.lit("<"), "predicate", F.lit(">"))).otherwise(F.col("predicate")).alias("curie")).distinct(),
       "select distinct predicate,case when regexp_matches(predicate,'^[Qq][0-9]+$') then concat('wd:',predicate) when regexp_matches(predicate,'^[Pp][0-9]+$') then concat('wdt:',predicate) when regexp_matches(predicate,'^https?://') then concat('<',predicate,'>') else predicate end curie from write_prop_stats")
define("host_lowercase", lambda v: v.web.select("r", F.when(F.lower("r").startswith("<http://schema.example/"), F.lower("r")).otherwise(F.col("r")).alias("iri")).distinct(), "select distinct r,case when starts_with(lower(r),'<http://schema.example/') then lower(r) else r end iri from web", "web")
define("pid_extract", lambda v: v.table("attr_triples_2").select("r", F.upper(F.regexp_extract("r", r"(?i)/(p[0-9]+)>?$", 1)).alias("pid")).where("pid <> ''").distinct(), "select distinct r,upper(regexp_extract(r,'(?i)/(p[0-9]+)>?$',1)) pid from attr_triples_2 where regexp_matches(r,'(?i)/(p[0-9]+)>?$')")
define("property_variants", lambda v: v.table("region").select(F.concat(F.lit("P"), "r_regionkey").alias("pid")).select("pid", F.explode(F.array(*[F.concat(F.lit(f"http://www.wikidata.example/{p}"), "pid") for p in ("entity/", "prop/", "prop/direct/", "prop/statement/", "prop/qualifier/", "prop/reference/")])).alias("uri")),
       "select concat('P',r_regionkey) pid,concat('http://www.wikidata.example/',p,'P',r_regionkey) uri from region, (values ('entity/'),('prop/'),('prop/direct/'),('prop/statement/'),('prop/qualifier/'),('prop/reference/')) x(p)")
define("trim_quotes", lambda v: v.web.select("t", F.lower(F.expr("trim(both '\"' from t)")).alias("v")).distinct(), "select distinct t,lower(trim(t,'\"')) v from web where true", "web")
define("number_detect", lambda v: v.web.select("t", F.expr("try_cast(trim(both '\"' from t) as double) is not null").alias("is_number")).where(F.col("t").rlike('^"?-?[0-9]+([.][0-9]+)?"?$')).distinct(), """select distinct t,true is_number from web where regexp_matches(t,'^"?-?[0-9]+([.][0-9]+)?"?$')""", "web")
define("zoom_weight", lambda v: v.table("lineitem").select("l_orderkey", "l_linenumber", r6(1 - (1 - F.col("l_discount")) * 0.5 / (1 - F.lit(0.0)), "w")), "select l_orderkey,l_linenumber,round(1-(1-l_discount)*0.5,6) w from lineitem")
define("tokens_padded", lambda v: v.table("part").select("p_partkey", F.array_join(F.slice(F.concat(F.split(F.regexp_replace(F.lower("p_name"), "[^a-z0-9 ]", ""), " "), F.array_repeat(F.lit("#"), 4)), 1, 4), " ").alias("words")), "select p_partkey,array_to_string(list_concat(string_split(regexp_replace(lower(p_name),'[^a-z0-9 ]','','g'),' '),['#','#','#','#'])[1:4],' ') words from part")
define("char_vocabulary", lambda v: v.table("part").select(F.explode(F.split("p_name", "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.sum("n").over(Window.partitionBy())).where("n >= m * 0.0001").select("c", "n"), "with x as (select unnest(string_split(p_name,'')) c from part), y as (select c,count(*) n from x where c<>'' group by c) select c,n from y where n>=(select sum(n) from y)*0.0001")
define("normalize_key", lambda v: v.table("part").select("p_partkey", normalize_key("p_name").alias("k")), "select p_partkey,regexp_replace(lower(p_name),'[^a-z0-9]','','g') k from part")
define("token_jaccard", lambda v: v.table("part").withColumn("x", F.array_distinct(F.split("p_name", " "))).withColumn("y", F.array_distinct(F.split(F.lower("p_type"), " "))).select("p_partkey", r6(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), "sim")), "select p_partkey,round(len(list_intersect(x,y))/len(list_distinct(list_concat(x,y))),6) sim from (select p_partkey,list_distinct(string_split(p_name,' ')) x,list_distinct(string_split(lower(p_type),' ')) y from part)")


@query("label_edit_match", "with a as (select distinct lower(p_name) x from part), m as (select p.x,q.x y,round(1-levenshtein(p.x,q.x)/least(length(p.x),length(q.x)),4) s from a p join a q on p.x<>q.x and (left(p.x,4)=left(q.x,4))) select x,y,s from m where s>=0.4")
def label_edit_match(v: Views) -> DataFrame:
    """Distinct labels alike by edit distance, among those that begin alike."""
    a = v.table("part").select(F.lower("p_name").alias("x")).distinct()
    m = a.withColumn("k", F.substring("x", 1, 4)).join(a.select(F.col("x").alias("y"), F.substring("x", 1, 4).alias("k")), "k").where("x <> y")
    return m.select("x", "y", F.round(1 - F.levenshtein("x", "y") / F.least(F.length("x"), F.length("y")), 4).alias("s")).where("s >= 0.4")


# vectors
for _m, _e in (("inner", "list_dot_product(a.vec,b.vec)"), ("cosine", "list_cosine_similarity(a.vec,b.vec)"), ("euclidean", "1-list_distance(a.vec,b.vec)"), ("manhattan", "1-list_sum(list_transform(list_zip(a.vec,b.vec), lambda z: abs(z[1]-z[2])))")):
    define(f"sim_{_m}", lambda v, m=_m: vec.search(v.spark, v.v1, v.v2, 10, m).select("i", "j", r6(F.col("sim"), "sim"), "rank"),
           f"with p as (select a.id i,b.id j,{_e} sim from v1 a,v2 b), k as (select *,row_number() over (partition by i order by sim desc,j) as rank from p) select i,j,round(sim,6) sim,rank from k where rank<=10", "v1", "v2")
    define(f"pair_confidence_{_m}", lambda v, m=_m: vec.pair_similarity(v.v1.select(F.col("id").alias("i"), F.col("id").alias("j")), v.v1, v.v2, m).select("i", "j", r6(F.col("sim"), "sim")), f"select a.id i,b.id j,round({_e},6) sim from v1 a join v2 b on a.id=b.id", "v1", "v2")
define("self_knn", lambda v: vec.search(v.spark, v.v1, v.v1, 10).select("i", "j", "rank"), "select i,j,rank from (select a.id i,b.id j,row_number() over (partition by a.id order by list_dot_product(a.vec,b.vec) desc,b.id) as rank from v1 a,v1 b) where rank<=10", "v1")
define("l1_hard_negatives", lambda v: vec.search(v.spark, v.v1, v.v1, 5, "manhattan").select("i", "j", "rank"), "select i,j,rank from (select a.id i,b.id j,row_number() over (partition by a.id order by list_sum(list_transform(list_zip(a.vec,b.vec), lambda z: abs(z[1]-z[2]))),b.id) as rank from v1 a,v1 b) where rank<=5", "v1")
define("l2_index_search", lambda v: vec.search(v.spark, v.v2, v.v1, 10, "euclidean").select("i", "j", "rank"), "select i,j,rank from (select b.id i,a.id j,row_number() over (partition by b.id order by list_distance(a.vec,b.vec),a.id) as rank from v1 a,v2 b) where rank<=10", "v1", "v2")
define("candidate_search", lambda v: vec.search(v.spark, v.v1.where(vec.norm("vec") > 0), v.v2.where(vec.norm("vec") > 0), 5, "cosine").select("i", "j", "rank"), "select i,j,rank from (select a.id i,b.id j,row_number() over (partition by a.id order by list_cosine_similarity(a.vec,b.vec) desc,b.id) as rank from v1 a,v2 b) where rank<=5", "v1", "v2")
define("threshold_pairs", lambda v: vec.search(v.spark, v.v1, v.v2, 50).where("sim > 0.3").select("i", "j"), "select i,j from (select *,row_number() over (partition by i order by sim desc,j) k from s) where k<=50 and sim>0.3", "s")
define("greedy_alignment", lambda v: vec.search(v.spark, v.v1, v.v2, 1).select("i", "j"), "select i,arg_max(j,sim) j from s group by i", "s")
define("mutual_nearest", lambda v: vec.search(v.spark, v.v1, v.v2, 1).select("i", "j").join(vec.search(v.spark, v.v2, v.v1, 1).select(F.col("i").alias("j"), F.col("j").alias("i")), ["i", "j"]), "with a as (select i,arg_max(j,sim) j from s group by i), b as (select j,arg_max(i,sim) i from s group by j) select a.i,a.j from a join b using(i,j)", "s")
define("bidirectional_topk", lambda v: vec.search(v.spark, v.v1, v.v2, 3).where("sim > 0.2").select("i", "j").unionByName(vec.search(v.spark, v.v2, v.v1, 3).where("sim > 0.2").select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), "with a as (select *,row_number() over (partition by i order by sim desc,j) k from s), b as (select *,row_number() over (partition by j order by sim desc,i) k from s) select i,j from a where k<=3 and sim>0.2 union select i,j from b where k<=3 and sim>0.2", "s")
define("nearest_description", lambda v: vec.search(v.spark, v.v1, v.v2, 1).where("sim >= 0.35").select("i", "j"), "select i,j from (select i,arg_max(j,sim) j,max(sim) m from s group by i) where m>=0.35", "s")


def _gold(v: Views) -> DataFrame:
    return vec.pair_similarity(v.v1.select(F.col("id").alias("i"), F.col("id").alias("j")), v.v1, v.v2)


METRICS = "select round(avg((k<=1)::int)*100,3) hits_1,round(avg((k<=5)::int)*100,3) hits_5,round(avg((k<=10)::int)*100,3) hits_10,round(avg((k<=50)::int)*100,3) hits_50,round(avg(k),4) mr,round(avg(1/k),6) mrr from g"
define("gold_rank_metrics", lambda v: vec.retrieval_metrics(vec.gold_ranks(v.spark, v.v1, v.v2, _gold(v))), "with d as (select i,sim from s where i=j), g as (select d.i,1+count(*) filter (s.sim>d.sim+1e-12) k from d join s on s.i=d.i group by d.i) " + METRICS, "s")
CSLS = "r1 as (select i,avg(sim) r from (select *,row_number() over (partition by i order by sim desc,j) k from s) where k<=10 group by i), r2 as (select j,avg(sim) r from (select *,row_number() over (partition by j order by sim desc,i) k from s) where k<=10 group by j), z as (select i,j,2*sim-r1.r-r2.r sim from s join r1 using(i) join r2 using(j))"
define("csls_rerank", lambda v: (lambda a, b: vec.search(v.spark, a, b, 10, "inner", 2.0).select("i", "j", r6(F.col("sim"), "sim"), "rank"))(*vec.csls(v.spark, v.v1, v.v2, 10)), f"with {CSLS}, k as (select *,row_number() over (partition by i order by sim desc,j) as rank from z) select i,j,round(sim,6) sim,rank from k where rank<=10", "s")


@query("gold_rank_metrics_csls", f"with {CSLS}, d as (select i,sim from z where i=j), g as (select d.i,1+count(*) filter (z.sim>d.sim+1e-12) k from d join z on z.i=d.i group by d.i) " + METRICS, "s")
def gold_rank_metrics_csls(v: Views) -> DataFrame:
    a, b = vec.csls(v.spark, v.v1, v.v2, 10)
    g = _gold(v).join(a.select(F.col("id").alias("i"), F.col("bias").alias("x")), "i").join(b.select(F.col("id").alias("j"), F.col("bias").alias("y")), "j")
    return vec.retrieval_metrics(vec.gold_ranks(v.spark, a, b, g.select("i", (2 * F.col("sim") + F.col("x") + F.col("y")).alias("sim")), 2.0))


def _top(v: Views, k: int = 100) -> DataFrame:
    return vec.search(v.spark, v.v1, v.v2, k).select("i", "j", "sim")


define("stable_matching", lambda v: vec.stable_matching(Scratch(v.spark, "stable"), _top(v)).select("i", "j", r6(F.col("sim"), "sim")))
define("max_weight_matching", lambda v: vec.dominant_matching(Scratch(v.spark, "dominant"), _top(v, 10)).select("i", "j", r6(F.col("sim"), "sim")))
define("bootstrapping_edit", lambda v: vec.edit_alignment(vec.search(v.spark, v.v1, v.v2, 2).where("rank = 2").select("i", "j", "sim"), vec.search(v.spark, v.v1, v.v2, 1).select("i", "j", "sim")).select("i", "j"),
       "select i,j from (select i,j,row_number() over (partition by j order by sim desc,i) k from (select i,arg_max(j,sim) j,max(sim) sim from s group by i)) where k=1", "s")
define("alignment_prf", lambda v: vec.search(v.spark, v.v1, v.v2, 5).select("i", "j").agg(r6(F.avg((F.col("i") == F.col("j")).cast("double")), "precision")).join(F.broadcast(vec.search(v.spark, v.v1, v.v2, 5).where("i = j").agg(F.count(F.lit(1)).alias("n_right")))),
       "with k as (select i,j,row_number() over (partition by i order by sim desc,j) k from s) select round(avg((i=j)::int),6) as precision,count(*) filter (i=j) n_right from k where k<=5", "s")
define("dangling_detection", lambda v: vec.search(v.spark, v.v1, v.v2, 1).select("i", (1 - F.col("sim")).alias("d")).withColumn("m", F.avg("d").over(Window.partitionBy())).groupBy((F.col("i") % 2 == 1).alias("truth"), (F.col("d") > F.col("m")).alias("said")).agg(F.count(F.lit(1)).alias("n")),
       "with d as (select i,1-max(sim) d from s group by i), m as (select avg(d) m from d) select i%2=1 truth,d>m said,count(*) n from d,m group by 1,2", "s")
define("two_step_dangling", lambda v: vec.search(v.spark, v.v1, v.v2, 1).withColumn("m", F.avg("sim").over(Window.partitionBy())).where("sim >= m").agg(F.count(F.lit(1)).alias("n_kept"), F.sum((F.col("i") == F.col("j")).cast("bigint")).alias("n_right")),
       "with d as (select i,arg_max(j,sim) j,max(sim) x from s group by i) select count(*) n_kept,coalesce(sum((i=j)::int),0)::bigint n_right from d where x>=(select avg(x) from d)", "s")
define("hubness", lambda v: v.v2.select(F.col("id").alias("j")).join(vec.search(v.spark, v.v1, v.v2, 6).where("rank >= 2").groupBy("j").agg(F.count(F.lit(1)).alias("n")), "j", "left").groupBy(F.when(F.col("n") >= 5, "hub").when(F.col("n") >= 1, "some").otherwise("none").alias("kind")).agg(F.count(F.lit(1)).alias("n")),
       "with k as (select j,row_number() over (partition by i order by sim desc,j) k from s), c as (select v2.id,count(k.j) n from v2 left join (select j from k where k between 2 and 6) k on k.j=v2.id group by 1) select case when n>=5 then 'hub' when n>=1 then 'some' else 'none' end kind,count(*) n from c group by 1", "s")
define("rank_profile", lambda v: vec.search(v.spark, v.v1, v.v2, 10).groupBy("rank").agg(r6(F.avg("sim"), "mean")), "select rank,round(avg(sim),6) mean from (select sim,row_number() over (partition by i order by sim desc,j) as rank from s) where rank<=10 group by 1", "s")
define("neighbor_mix", lambda v: vec.search(v.spark, v.v1, v.v1.unionByName(v.v2.select((F.col("id") + 1_000_000).alias("id"), "vec")), 11).where("rank >= 2").groupBy("i").agg(F.sum((F.col("j") < 1_000_000).cast("bigint")).alias("own"), r6(F.avg("sim"), "mean")),
       "with a as (select id,vec from v1 union all select id+1000000,vec from v2), k as (select v1.id i,a.id j,list_dot_product(v1.vec,a.vec) sim,row_number() over (partition by v1.id order by list_dot_product(v1.vec,a.vec) desc,a.id) k from v1,a) select i,sum((j<1000000)::int)::bigint own,round(avg(sim),6) mean from k where k between 2 and 11 group by i", "v1", "v2")


@query("similarity_profile", "with p as (select i,avg(sim) mean,max(sim) mx from s group by i) select round(avg(mean),6) mean,round(avg(mx),6) best from p", "s")
def similarity_profile(v: Views) -> DataFrame:
    """Mean and best similarity a row, averaged; the mean of a row is its product with the mean vector."""
    mean = v.v2.select(F.posexplode("vec").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m")).agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("ms")).select(F.transform("ms", lambda x: x.m).alias("mv"))
    rows = v.v1.join(F.broadcast(mean)).agg(r6(F.avg(vec.dot("vec", "mv")), "mean"))
    return rows.join(F.broadcast(vec.search(v.spark, v.v1, v.v2, 1).agg(r6(F.avg("sim"), "best"))))


define("conicity", lambda v: vec.conicity(v.v1), "with m as (select p,avg(vec[p]) m from v1, range(1,65) r(p) group by p), mv as (select list(m order by p) mv from m), a as (select list_dot_product(vec,mv)/sqrt(list_dot_product(mv,mv)) atm from v1,mv) select round(avg(atm),6) conicity,round(var_pop(atm),6) spread from a", "v1")


def _triples_of_vectors(v: Views) -> DataFrame:
    """(id, h, r, t): vectors of neighbouring ids as heads, relations and tails."""
    e = v.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("h"))
    at = lambda n, k: e.select((F.col("id") - k).alias("id"), F.col("h").alias(n))
    return e.join(at("r", 1), "id").join(at("t", 2), "id")


TRI = "tri as (select a.vec_id id,a.embedding::DOUBLE[] h,b.embedding::DOUBLE[] r,c.embedding::DOUBLE[] t from embeddings a join embeddings b on b.vec_id=a.vec_id+1 join embeddings c on c.vec_id=a.vec_id+2)"
zip3 = lambda x, y, z: F.zip_with(F.zip_with(x, y, lambda a, b: a + b), z, lambda a, b: a - b)
total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
Z3 = "list_transform(list_zip(h,r,t), lambda z: z[1]+z[2]-z[3])"
define("transe_score", lambda v: _triples_of_vectors(v).select("id", r6(total(zip3("h", "r", "t"), F.abs), "l1"), r6(total(zip3("h", "r", "t"), lambda x: x * x), "l2")), f"with {TRI} select id,round(list_sum(list_transform({Z3}, lambda x: abs(x))),6) l1,round(list_sum(list_transform({Z3}, lambda x: x*x)),6) l2 from tri")
define("transh_score", lambda v: _triples_of_vectors(v).withColumn("d", F.zip_with("h", "t", lambda a, b: a - b)).withColumn("k", vec.dot("d", "r") / vec.dot("r", "r")).withColumn("p", F.zip_with("d", "r", lambda a, b: a - F.col("k") * b)).select("id", r6(total("p", lambda x: x * x), "l2")),
       f"with {TRI}, x as (select *,list_dot_product(list_transform(list_zip(h,t), lambda z: z[1]-z[2]),r)/list_dot_product(r,r) k from tri) select id,round(list_sum(list_transform(list_zip(h,t,r), lambda z: (z[1]-z[2]-k*z[3])*(z[1]-z[2]-k*z[3]))),6) l2 from x")
define("transd_score", lambda v: _triples_of_vectors(v).withColumn("q", F.zip_with("h", "r", lambda a, b: a + vec.dot("h", "t") * b)).select("id", r6(vec.norm("q"), "n")), f"with {TRI}, x as (select *,list_dot_product(h,t) k from tri) select id,round(sqrt(list_sum(list_transform(list_zip(h,r), lambda z: (z[1]+k*z[2])*(z[1]+k*z[2])))),6) n from x")
define("distmult_score", lambda v: _triples_of_vectors(v).select("id", r6(vec.dot(F.zip_with("h", "r", lambda a, b: a * b), "t"), "s")), f"with {TRI} select id,round(list_sum(list_transform(list_zip(h,r,t), lambda z: z[1]*z[2]*z[3])),6) s from tri")
define("simple_score", lambda v: _triples_of_vectors(v).select("id", r6((vec.dot(F.zip_with("h", "r", lambda a, b: a * b), "t") + vec.dot(F.zip_with("t", "r", lambda a, b: a * b), "h")) / 2, "s")), f"with {TRI} select id,round(list_sum(list_transform(list_zip(h,r,t), lambda z: z[1]*z[2]*z[3])),6) s from tri")
HALF = 32
cos_sin = lambda part: F.transform("r", F.cos if part else F.sin)


@query("rotate_score", f"with {TRI}, x as (select id,i,h[i]*cos(r[i])-h[i+32]*sin(r[i])-t[i] re,h[i]*sin(r[i])+h[i+32]*cos(r[i])-t[i+32] im from tri, range(1,33) g(i)) select id,round(12-sum(sqrt(re*re+im*im)),6) s from x group by id")
def rotate_score(v: Views) -> DataFrame:
    """Margin 12 less the distance of head, turned by the relation's angles, to tail; halves are real and imaginary parts."""
    x = _triples_of_vectors(v).select("id", "h", "t", F.posexplode(F.slice("r", 1, HALF)).alias("p", "a"))
    at = lambda c, k: F.element_at(c, F.col("p") + 1 + k)
    re_, im = at("h", 0) * F.cos("a") - at("h", HALF) * F.sin("a") - at("t", 0), at("h", 0) * F.sin("a") + at("h", HALF) * F.cos("a") - at("t", HALF)
    return x.groupBy("id").agg(r6(12 - F.sum(F.sqrt(re_ * re_ + im * im)), "s"))


@query("hole_score", f"with {TRI}, x as (select id,k,list_sum(list_transform(range(1,65), lambda i: h[i]*t[(i-1+k)%64+1])) c from tri, range(0,64) g(k)) select id,round(-1/(1+exp(-sum(r[k+1]*c))),6) s from x join tri using(id) group by id")
def hole_score(v: Views) -> DataFrame:
    """Circular correlation of head and tail against the relation, through the logistic."""
    x = _triples_of_vectors(v).withColumn("tt", F.concat("t", "t"))
    corr = F.transform("r", lambda r, k: r * F.aggregate(F.zip_with("h", F.slice("tt", k + 1, F.size("h")), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y))
    return x.select("id", r6(-1 / (1 + F.exp(-F.aggregate(corr, F.lit(0.0), lambda s, y: s + y))), "s"))


define("margin_loss", lambda v: _triples_of_vectors(v).withColumn("p", total(zip3("h", "r", "t"), lambda x: x * x)).withColumn("n", total(zip3("t", "r", "h"), lambda x: x * x)).agg(r6(F.sum(F.greatest(F.lit(0.0), 1.5 + F.col("p") - F.col("n"))), "margin"), r6(F.sum(F.log1p(F.exp("p")) + F.log1p(F.exp(-F.col("n")))), "logistic"), r6(F.sum(F.greatest(F.lit(0.0), F.col("p") - 0.5) + 0.8 * F.greatest(F.lit(0.0), 2.0 - F.col("n"))), "limited")),
       f"with {TRI}, x as (select list_sum(list_transform({Z3}, lambda x: x*x)) p,list_sum(list_transform(list_zip(t,r,h), lambda z: (z[1]+z[2]-z[3])*(z[1]+z[2]-z[3]))) n from tri) select round(sum(greatest(0,1.5+p-n)),6) margin,round(sum(ln(1+exp(p))+ln(1+exp(-n))),6) logistic,round(sum(greatest(0,p-0.5)+0.8*greatest(0,2.0-n)),6) limited from x")
define("align_logsigmoid_loss", lambda v: _gold(v).agg(r6(-F.sum(F.log(1 / (1 + F.exp(-F.col("sim"))))), "loss")), "select round(-sum(ln(1/(1+exp(-list_dot_product(a.vec,b.vec))))),6) loss from v1 a join v2 b on a.id=b.id", "v1", "v2")
define("view_weights", lambda v: vec.pair_similarity(v.v1.select(F.col("id").alias("i"), F.col("id").alias("j")), v.v1, v.v2, "cosine").agg(r6(F.avg("sim"), "w")), "select round(avg(list_cosine_similarity(a.vec,b.vec)),6) w from v1 a join v2 b on a.id=b.id", "v1", "v2")
PLANES = [[1.0 if (7 * i + 3 * p) % 5 < 2 else -1.0 for i in range(64)] for p in range(6)]
define("lsh_buckets", lambda v: vec.hyperplane_codes(v.v1, PLANES).groupBy("code").agg(F.count(F.lit(1)).alias("n")), "select concat(" + ",".join(f"case when list_dot_product(vec,{p}::DOUBLE[])>=0 then '1' else '0' end" for p in PLANES) + ") code,count(*) n from v1 group by 1", "v1")
define("crossfold_mean_std", lambda v: t3.folds(v.links).where("part = 'test'").groupBy("fold").agg(F.avg(F.length("e1")).alias("x")).agg(r6(F.avg("x"), "mean"), r6(F.stddev("x"), "std")),
       "with f as (select fold,e1,row_number() over (partition by fold order by md5(concat(fold,'|',e1,'|',e2)),e1,e2) k,count(*) over (partition by fold) n from links, range(1,6) r(fold)), g as (select fold,avg(length(e1)) x from f where k>floor(n*0.7)+floor(n*0.2) group by fold) select round(avg(x),6) mean,round(stddev(x),6) std from g", "links")


# files: written to the shared folder and read again

def _round_trip(v: Views, rows: DataFrame, write=None) -> str:
    scratch = Scratch(v.spark, "files")
    path = f"{scratch.root}/rows"
    (write or files.write_rows)(rows, path)
    return path


define("read_relation_triples", lambda v: files.read_relations(v.spark, _round_trip(v, v.place)), "select distinct h,r,t from place", "place")
define("read_attribute_triples", lambda v: files.read_attributes(v.spark, _round_trip(v, v.attr2)), "select distinct e,a,v from attr2", "attr2")
define("read_links", lambda v: files.read_links(v.spark, _round_trip(v, v.links.select("e1", "e2"))).select("e1", "e2"), "select e1,e2 from links", "links")
define("read_link_table", lambda v: files.read_link_table(v.spark, _round_trip(v, v.table("read_links").where(~F.concat("wdc_iri", "wikidata_uri").contains("\t")).select("wdc_iri", "wikidata_uri"))),
       "select trim(wdc_iri,' ') wdc_iri,trim(wikidata_uri,' ') wikidata_uri from read_links where not contains(wdc_iri||wikidata_uri,chr(9))")
define("read_id_dictionary", lambda v: files.read_ids(v.spark, _round_trip(v, v.table("customer").select("c_name", "c_custkey"))), "select c_name uri,c_custkey id from customer")
define("read_word_vectors", lambda v: files.read_word_vectors(v.spark, _round_trip(v, v.v1, files.write_vectors), 64).select("word", r6(F.element_at("vec", 1), "x")), "select id::varchar word,round(vec[1],6) x from v1", "v1")
define("same_as_export", lambda v: files.same_as(v.links), "select concat('<',e1,'> <http://www.w3.org/2002/07/owl#sameAs> <',e2,'> .') as value from links", "links")
define("predicate_statistics", lambda v: files.predicate_statistics(v.rel1, v.spark.createDataFrame([("placedBy", "placed by")], "r string, label string")), "select r predicate,count(*) count,case r when 'placedBy' then 'placed by' else r end as label from rel1 group by r", "rel1")
define("json_export", lambda v: files.as_json(v.table("region").select("r_regionkey", "r_name")), """select concat('{"r_regionkey":',r_regionkey,',"r_name":"',r_name,'"}') as value from region""")
define("link_export_detail", lambda v: v.table("read_links").groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.min("min_len").alias("shortest")), "select method,count(*) n,min(min_len) shortest from read_links group by method")

# names of vocabularies
define("name_ratio_match", lambda v: names.mutual_best(v.table("region").select(F.lower("r_name").alias("x")), v.table("part").select(F.lower("p_type").alias("y")), 0.2).withColumn("sim", F.round("sim", 6)))
define("coalign_entities", lambda v: names.mediated(v.attr2.where("a = 'brand' or a = 'label'"), v.attr2.where("e like 'p1%'").select((F.concat(F.lit("x"), "e")).alias("e"), "a", "v"), v.spark.createDataFrame([("label", "label"), ("brand", "brand")], "a1 string, a2 string"), 0.9, 6),
       "with p as (select distinct e,a,lower(v) v from attr2 where a in ('brand','label')), q as (select distinct concat('x',e) e,a,lower(v) v from attr2 where e like 'p1%'), n as (select p.e e1,q.e e2,count(distinct p.a) n from p join q on p.a=q.a and p.v=q.v group by 1,2), m as (select e,count(distinct a) m from p group by e) select e1,e2,round(n/m,6) sim from n join m on m.e=e1 where n/m>0.9", "attr2")
define("coalign_attributes", lambda v: names.attribute_votes(v.attr1, v.attr2, v.links).withColumn("sim", F.round("sim", 6)), "select x.a a1,y.a a2,round(avg((lower(x.v)=lower(y.v))::int),6) sim from attr1 x join links on x.e=e1 join attr2 y on y.e=e2 group by 1,2", "attr1", "attr2", "links")
define("predicate_refresh", lambda v: names.refreshed(vec.search(v.spark, v.v1, v.v2, 1).select(F.col("i").alias("x"), F.col("j").alias("y"), "sim"), vec.search(v.spark, v.v1, v.v2, 1, "cosine").select(F.col("i").alias("x"), F.col("j").alias("y"), "sim"), 0.3).select("x", "y", r6(F.col("w"), "w")),
       "with a as (select i,arg_max(j,sim) j,max(sim) sim from s group by i), w as (select i x,j y,0.7*sim+0.3*list_cosine_similarity(p.vec,q.vec) w from a join v1 p on p.id=i join v2 q on q.id=j) select x,y,round(w,6) w from w where w>0.3", "s")
define("likelihood_matrix", lambda v: v.v1.select(F.col("id").alias("i")).withColumn("w", F.when(F.col("i") % 3 == 0, F.lit(1.0)).otherwise(1 / F.count(F.lit(1)).over(Window.partitionBy()))).select("i", r6(F.col("w"), "w")), "select id i,round(case when id%3=0 then 1.0 else 1/count(*) over () end,6) w from v1", "v1")
MCD = "t as (select (select count(*) from v1) n,(select count(*) from v2) m), g as (select i,sum(sim) r from s group by i), c as (select j,sum(sim) c from s group by j), z as (select i,j,(sim-(r+c-sim)/(n+m-1))*(sim-(r+c-sim)/(n+m-1)) sim from s join g using(i) join c using(j),t)"


@query("mcd_rerank", f"with {MCD} select i,round(max(sim),6) best from z group by i", "s")
def mcd_rerank(v: Views) -> DataFrame:
    """The greatest squared deviation of each row's similarities from what their row and column sums let expect.

    The sums are products with the sum vectors, so the matrix is met once, in blocks, and never written.
    """
    total = lambda x: x.select(F.posexplode("vec").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("m")).agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("ms")).select(F.transform("ms", lambda y: y.m).alias("sv"))
    n = v.v1.count() + v.v2.count() - 1
    one = v.v1.join(F.broadcast(total(v.v2))).select("id", "vec", (-vec.dot("vec", "sv") / n).alias("bias"))
    two = v.v2.join(F.broadcast(total(v.v1))).select("id", "vec", (-vec.dot("vec", "sv") / n).alias("bias"))
    high = vec.search(v.spark, one, two, 1, "inner", 1 + 1 / n).select("i", "sim")
    less = lambda x: x.select("id", "vec", (-F.col("bias")).alias("bias"))
    low = vec.search(v.spark, less(one), less(two), 1, "inner", -(1 + 1 / n)).select("i", F.col("sim").alias("neg"))
    return high.join(low, "i").select("i", r6(F.greatest(F.col("sim") * F.col("sim"), F.col("neg") * F.col("neg")), "best"))


define("quartile_deviation", lambda v: vec.search(v.spark, v.v1, v.v2, 11).groupBy("i").agg(F.sum((F.col("j") % 2 == 0).cast("bigint")).alias("own")).agg((F.expr("percentile(own, 0.75)") - F.expr("percentile(own, 0.25)")).alias("deviation")), "with k as (select i,sum((j%2=0)::int) own from (select *,row_number() over (partition by i order by sim desc,j) k from s) where k<=11 group by i) select quantile_cont(own,0.75)-quantile_cont(own,0.25) deviation from k", "s")
define("early_stopping", lambda v: v.table("events").groupBy(F.expr("event_id div 1000").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("flag")).withColumn("a", F.lag("flag", 2).over(Window.orderBy("epoch"))).withColumn("b", F.lag("flag", 1).over(Window.orderBy("epoch"))).select("epoch", F.coalesce((F.col("flag") <= F.col("b")) & (F.col("b") <= F.col("a")), F.lit(False)).alias("stop")),
       "with e as (select event_id//1000 epoch,round(avg(value),6) flag from events group by 1) select epoch,coalesce(flag<=lag(flag) over w and lag(flag) over w<=lag(flag,2) over w,false) stop from e window w as (order by epoch)")
define("batch_slices", lambda v: v.place.groupBy("r").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.floor(F.lit(100) * F.col("n") / F.sum("n").over(Window.partitionBy())).cast("bigint")).select("r", "size"), "select r,floor(100*count(*)/sum(count(*)) over ())::bigint size from place group by r", "place")
define("character_ids", lambda v: v.table("region").select("r_name", F.array_join(F.transform(F.slice(F.concat(F.split("r_name", ""), F.array_repeat(F.lit("#"), 12)), 1, 12), lambda x: F.when(x.between("A", "Z"), F.ascii(x) - 64).otherwise(0).cast("string")), ",").alias("ids")),
       "select r_name,array_to_string(list_transform(list_concat(string_split(r_name,''),['#','#','#','#','#','#','#','#','#','#','#','#'])[1:12], lambda x: case when x between 'A' and 'Z' then (ascii(x)-64)::varchar else '0' end),',') ids from region")
define("orthogonal_mapping_loss", lambda v: _gold(v).agg(r6(F.sum((1 - F.col("sim")) * 2), "loss")), "select round(sum((1-list_dot_product(a.vec,b.vec))*2),6) loss from v1 a join v2 b on a.id=b.id", "v1", "v2")
define("softplus_scores", lambda v: _gold(v).select("i", r6(F.log1p(F.exp(-F.col("sim"))), "softplus"), r6(1 / (1 + F.exp(-F.col("sim"))), "sigmoid")), "select a.id i,round(ln(1+exp(-list_dot_product(a.vec,b.vec))),6) softplus,round(1/(1+exp(-list_dot_product(a.vec,b.vec))),6) sigmoid from v1 a join v2 b on a.id=b.id", "v1", "v2")


@query("random_walks")
def random_walks(v: Views) -> DataFrame:
    """(start, step, e): walks of four steps from every nation and region over undirected edges, each step the neighbour of least -ln(u) / w, u from a hash."""
    edges = t3.one_hop(v.place).select("a", "b")
    walk = v.table("nation").select(v.key("n", "n_nationkey").alias("start")).select("start", F.lit(0).cast("bigint").alias("step"), F.col("start").alias("e"))
    out = walk
    for i in range(1, 5):
        u = (F.conv(F.substring(F.md5(F.concat_ws("|", "start", F.lit(i), "b")), 1, 8), 16, 10).cast("double") + 1) / F.lit(2.0 ** 32 + 1)
        step = walk.join(edges, walk.e == edges.a).withColumn("cost", -F.log(u)).groupBy("start").agg(F.min(F.struct("cost", "b")).alias("x"))
        walk = step.select("start", F.lit(i).cast("bigint").alias("step"), F.col("x.b").alias("e"))
        out = out.unionByName(walk)
    return out


@query("stream_links")
def stream_links(v: Views) -> DataFrame:
    """Names in arriving dump lines linked to the labels of graph 2, by a stream that reads what is there and ends."""
    from kinloom.streaming.links import link_stream, read_lines, run_once

    label = "http://www.w3.example/2000/01/rdf-schema#label"
    keys = v.table("attr_triples_2").where(schema_term(F.col("r")) == label).select(record_name(F.col("h")).alias("entity"), literal_text(F.col("t")).alias("value")).where("entity is not null")
    scratch = Scratch(v.spark, "stream")
    arrived = scratch.write(v.table("parse_nq_or_nt").select("line", "loaded_at"))
    return run_once(link_stream(read_lines(v.spark, arrived._scratch_path), keys, "http://schema.example/name"), f"{scratch.root}/out", f"{scratch.root}/state")


define("chebyshev_2", lambda v: t3.chebyshev(t3.one_hop(v.place.where("h like 'n%'")).withColumn("w", F.lit(1.0)), 2)[2].select("a", "b", r6(F.col("w"), "w")),
       "with n as (select h a,t b from place where h like 'n%' union select t,h from place where h like 'n%'), d as (select a,count(*) d from n group by a), l as (select n.a,n.b,-1/sqrt(x.d)/sqrt(y.d) w from n join d x on x.a=n.a join d y on y.a=n.b), u as (select p.a,q.b,2*p.w*q.w w from l p join l q on p.b=q.a union all select a,a,-1.0 from d) select a,b,round(sum(w),6) w from u group by 1,2", "place")
define("label_enrichment", lambda v: t3.enriched(v.place, v.table("nation").select(v.key("n", "n_nationkey").alias("uri"), F.col("n_name").alias("label"))), "with u as (select h uri from place union select r from place union select t from place) select uri,n_name as label from u left join nation on uri=concat('n',n_nationkey)", "place")
define("dump_extract", lambda v: load_statements(v.table("parse_nq_or_nt"), "line_id", "line").where("reason is null and g is not null and not (o rlike '\"@[A-Za-z-]+$')").select("line_id", "s", "p", "o"))
define("clean_literals", lambda v: v.table("part").select("p_partkey", literal_text(F.concat(F.lit('"'), "p_name", F.lit('"@en'))).alias("v")), "select p_partkey,p_name v from part")
define("negative_relations", lambda v: v.place.withColumn("d", F.conv(F.substring(F.md5(F.concat_ws("|", "h", "r", "t")), 1, 8), 16, 10).cast("bigint") % 2).select("h", F.when(F.col("d") == 0, "inNation").otherwise("inRegion").alias("nr"), "t", "r").where("nr <> r").select("h", "nr", "t").join(v.place.select("h", F.col("r").alias("nr"), "t"), ["h", "nr", "t"], "left_anti"),
       "with x as (select h,r,t,case when ('0x'||substring(md5(concat(h,'|',r,'|',t)),1,8))::bigint%2=0 then 'inNation' else 'inRegion' end nr from place) select h,nr,t from x where nr<>r and not exists (select 1 from place p where p.h=x.h and p.r=x.nr and p.t=x.t)", "place")
