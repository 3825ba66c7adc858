"""The test tables as graphs, links, vectors and observations, for DataFrames and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.session import table

CTE = {
    "rel1": "select concat('o',o_orderkey) h,'placedBy' r,concat('c',o_custkey) t from orders union all select concat('c',c_custkey),'inNation',concat('n',c_nationkey) from customer "
            "union all select concat('n',n_nationkey),'inRegion',concat('r',n_regionkey) from nation union all select concat('c',c_custkey),'inRegion',concat('r',n_regionkey) from customer join nation on c_nationkey=n_nationkey",
    "place": "select * from rel1 where r <> 'placedBy'",
    "rel2": "select distinct concat('p',l_partkey) h,'suppliedBy' r,concat('s',l_suppkey) t from lineitem union all select concat('s',s_suppkey),'locatedIn',concat('n',s_nationkey) from supplier "
            "union all select concat('n',n_nationkey),'partOf',concat('r',n_regionkey) from nation",
    "attr1": "select concat('c',c_custkey) e,'name' a,c_name v from customer union all select concat('c',c_custkey),'segment',c_mktsegment from customer union all select concat('n',n_nationkey),'name',n_name from nation "
             "union all select concat('o',o_orderkey),'priority',o_orderpriority from orders union all select concat('o',o_orderkey),'status',o_orderstatus from orders",
    "attr2": "select concat('p',p_partkey) e,'label' a,p_name v from part union all select concat('p',p_partkey),'brand',p_brand from part union all select concat('p',p_partkey),'type',p_type from part union all select concat('s',s_suppkey),'label',s_name from supplier",
    "links": "select concat('c',c_custkey) e1,concat('s',s_suppkey) e2, c_custkey pos from customer join supplier on c_custkey=s_suppkey",
    "v1": "select vec_id//2 id, embedding::DOUBLE[] vec from embeddings where vec_id%2=0",
    "v2": "select vec_id//2 id, embedding::DOUBLE[] vec from embeddings where vec_id%2=1",
    "s": "select a.id i,b.id j,list_dot_product(a.vec,b.vec) sim from v1 a, v2 b",
    "obs": "select l_suppkey source,l_partkey k,l_returnflag v from lineitem",
    "web": "select h,r,t from attr_triples_1 where h is not null and r is not null and t is not null",
}
NEEDS = {"place": ["rel1"], "s": ["v1", "v2"]}


def sql(body: str, *views: str) -> str:
    """``body`` with the views it names before it."""
    names: list[str] = []
    for v in views:
        names += [n for n in [*NEEDS.get(v, []), v] if n not in names]
    own = ", ".join(f"{n} as ({CTE[n]})" for n in names)
    rest = body[5:] if body.startswith("with ") else None
    return f"with {own}{', ' + rest if rest else ' ' + body}" if names else body


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def _three(self, rows: DataFrame, names: str, *columns) -> DataFrame:
        return rows.select(*[(c if not isinstance(c, str) else F.lit(c)).alias(n) for n, c in zip(names, columns)])

    @staticmethod
    def key(letter: str, column: str):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    @property
    def rel1(self) -> DataFrame:
        k, o, c, n = self.key, self.table("orders"), self.table("customer"), self.table("nation")
        near = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
        return (self._three(o, "hrt", k("o", "o_orderkey"), "placedBy", k("c", "o_custkey")).unionByName(self._three(c, "hrt", k("c", "c_custkey"), "inNation", k("n", "c_nationkey")))
                .unionByName(self._three(n, "hrt", k("n", "n_nationkey"), "inRegion", k("r", "n_regionkey"))).unionByName(self._three(near, "hrt", k("c", "c_custkey"), "inRegion", k("r", "n_regionkey"))))

    @property
    def place(self) -> DataFrame:
        """rel1 without the orders."""
        return self.rel1.where("r <> 'placedBy'")

    @property
    def rel2(self) -> DataFrame:
        k, s, n = self.key, self.table("supplier"), self.table("nation")
        return (self._three(self.table("lineitem").select("l_partkey", "l_suppkey").distinct(), "hrt", k("p", "l_partkey"), "suppliedBy", k("s", "l_suppkey"))
                .unionByName(self._three(s, "hrt", k("s", "s_suppkey"), "locatedIn", k("n", "s_nationkey"))).unionByName(self._three(n, "hrt", k("n", "n_nationkey"), "partOf", k("r", "n_regionkey"))))

    @property
    def attr1(self) -> DataFrame:
        k, c, o = self.key, self.table("customer"), self.table("orders")
        one = lambda rows, key, a, v: self._three(rows, "eav", key, a, F.col(v))
        return (one(c, k("c", "c_custkey"), "name", "c_name").unionByName(one(c, k("c", "c_custkey"), "segment", "c_mktsegment")).unionByName(one(self.table("nation"), k("n", "n_nationkey"), "name", "n_name"))
                .unionByName(one(o, k("o", "o_orderkey"), "priority", "o_orderpriority")).unionByName(one(o, k("o", "o_orderkey"), "status", "o_orderstatus")))

    @property
    def attr2(self) -> DataFrame:
        k, p = self.key, self.table("part")
        one = lambda rows, key, a, v: self._three(rows, "eav", key, a, F.col(v))
        return (one(p, k("p", "p_partkey"), "label", "p_name").unionByName(one(p, k("p", "p_partkey"), "brand", "p_brand")).unionByName(one(p, k("p", "p_partkey"), "type", "p_type"))
                .unionByName(one(self.table("supplier"), k("s", "s_suppkey"), "label", "s_name")))

    @property
    def links(self) -> DataFrame:
        x = self.table("customer").join(self.table("supplier"), F.col("c_custkey") == F.col("s_suppkey"))
        return x.select(self.key("c", "c_custkey").alias("e1"), self.key("s", "s_suppkey").alias("e2"), F.col("c_custkey").alias("pos"))

    def _vectors(self, odd: int) -> DataFrame:
        return self.table("embeddings").where(F.col("vec_id") % 2 == odd).select(F.expr("vec_id div 2").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))

    @property
    def v1(self) -> DataFrame:
        return self._vectors(0)

    @property
    def v2(self) -> DataFrame:
        return self._vectors(1)

    @property
    def obs(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("v"))

    @property
    def web(self) -> DataFrame:
        return self.table("attr_triples_1").select("h", "r", "t").where("h is not null and r is not null and t is not null")
