"""Pixel, observation, rectangle and label tables derived from the given Parquet tables.

Each table has a DataFrame form (Spark side) and a SQL form (oracle side, used as a CTE).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Grid origin and pixel size shared by every derived table.
UL_X, UL_Y, RES = 1000000.0, 1200000.0, 30.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pixel(key: str) -> list:
    return [
        F.floor(F.col(key) / 50).cast("int").alias("row"),
        (F.col(key) % 50).cast("int").alias("col"),
    ]


def obs(spark, sf_dir) -> DataFrame:
    return as_obs(table(spark, sf_dir, "lineitem"))


def as_obs(items: DataFrame) -> DataFrame:
    """Image observations: one row per line item, pixel = part (50 columns)."""
    return items.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("obs_id"),
        *_pixel("l_partkey"),
        F.when(F.col("l_returnflag") == "R", "LC08")
        .when(F.col("l_returnflag") == "A", "LE07")
        .otherwise("LT05")
        .alias("sensor"),
        F.col("l_shipdate").alias("ts"),
        F.year("l_shipdate").alias("yr"),
        F.dayofyear("l_shipdate").alias("doy"),
        F.floor("l_quantity").cast("int").alias("b1"),
        F.round(F.col("l_discount") * 100).cast("int").alias("b2"),
        F.round(F.col("l_tax") * 100).cast("int").alias("b3"),
        (F.floor("l_extendedprice") % 1000).cast("int").alias("b4"),
        (F.col("l_suppkey") % 100).cast("int").alias("b5"),
        (F.col("l_linenumber") * 10).cast("int").alias("b7"),
        (F.col("l_orderkey") % 64).cast("int").alias("qa"),
    )


def dem(spark, sf_dir) -> DataFrame:
    """One elevation and one class value per pixel."""
    return table(spark, sf_dir, "part").select(
        *_pixel("p_partkey"),
        (F.col("p_size").cast("double") * 25).alias("z"),
        F.floor("p_retailprice").cast("int").alias("v"),
        F.col("p_size").alias("cls"),
    )


def samples(spark, sf_dir) -> DataFrame:
    """Sample points with a target, a value, a zone and tree predictors."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("obs_pt"),
        (F.lit(UL_X) + (k % 50) * RES + 7).alias("x"),
        (F.lit(UL_Y) - F.floor(k / 50) * RES - 7).alias("y"),
        *_pixel("c_custkey"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("zone"),
        F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("target"),
        F.col("c_acctbal").alias("val"),
    )


#: Metres from one row of sets to the next. Pixel rows grow by four where rows of sets grow by 1.25, so 96 m keeps up with them.
SET_STEP = 96


def sets(spark, sf_dir) -> DataFrame:
    """Support sets: overlapping 450 m squares, eight per row of sets; their rows grow with the pixels."""
    k = F.col("s_suppkey")
    ul_x = F.lit(UL_X) + (k % 8) * 150
    ul_y = F.lit(UL_Y) - F.floor(k / 8) * SET_STEP
    return table(spark, sf_dir, "supplier").select(
        k.alias("set_id"),
        ul_x.alias("ul_x"),
        ul_y.alias("ul_y"),
        (ul_x + 450).alias("lr_x"),
        (ul_y - 450).alias("lr_y"),
        (k * 7 % 101).cast("int").alias("oob_rate"),
        (k * 5 % 17).cast("int").alias("imp_0"),
        (k * 3 % 17).cast("int").alias("imp_1"),
        (k * 11 % 17).cast("int").alias("imp_2"),
    )


def tiles(spark, sf_dir) -> DataFrame:
    """Storage tiles: 150 m squares, ten per row; their rows grow with the pixels and cover all of them."""
    k = F.col("s_suppkey") - 1
    ul_x = F.lit(UL_X) + (k % 10) * 150
    ul_y = F.lit(UL_Y) - F.floor(k / 10) * 150
    return table(spark, sf_dir, "supplier").select(
        k.alias("tile_id"),
        F.col("s_name").alias("name"),
        (F.col("s_nationkey") % 5).alias("region_id"),
        ul_x.alias("ul_x"),
        ul_y.alias("ul_y"),
        (ul_x + 150).alias("lr_x"),
        (ul_y - 150).alias("lr_y"),
    )


#: Rings of a zone from its tile's upper-left corner: a concave outline and a hole.
ZONE_RINGS = [
    [(1, -1), (149, -31), (149, -149), (80, -101), (31, -149), (1, -70)],
    [(50, -50), (100, -65), (85, -95), (45, -80)],
]


def zones(spark, sf_dir) -> DataFrame:
    """Polygon zones, one ring per row: in each tile a concave outline with a hole."""
    out = None
    for ring in ZONE_RINGS:
        points = F.array(*[F.struct((F.col("ul_x") + x).alias("x"), (F.col("ul_y") + y).alias("y")) for x, y in ring])
        rows = tiles(spark, sf_dir).select("tile_id", "region_id", points.alias("ring"))
        out = rows if out is None else out.unionByName(rows)
    return out


def predictions(spark, sf_dir) -> DataFrame:
    """Ensemble members per pixel."""
    return table(spark, sf_dir, "lineitem").select(
        *_pixel("l_partkey"),
        F.col("l_suppkey").cast("int").alias("set_id"),
        F.col("l_linenumber").alias("pred"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("pred_nd"),
    )


def pairs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("truth"), F.col("toxic").alias("pred")
    )


def probs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("truth"),
        (F.floor("l_quantity").cast("int") * 2).alias("prob100"),
        F.floor("l_quantity").cast("int").alias("score"),
        F.col("l_suppkey").alias("set_id"),
    )


def task_events(spark, sf_dir) -> DataFrame:
    return as_task_events(table(spark, sf_dir, "events"))


def as_task_events(events: DataFrame) -> DataFrame:
    """Event rows read as a task log; works on batch and streaming frames."""
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").alias("task_id"),
        F.when(F.col("event_type") == "signup", "READY")
        .when(F.col("event_type") == "view", "RUNNING")
        .when(F.col("event_type") == "purchase", "COMPLETED")
        .when(F.col("event_type") == "error", "FAILED")
        .otherwise("INFO")
        .alias("state"),
    )


def label_points(spark, sf_dir) -> DataFrame:
    """Interpreter labels with the untidy codes and blanks such tables carry."""
    k = F.col("doc_id")

    def pick(n: int, values: list):
        out = F.lit(None).cast("string")
        for i, v in enumerate(values):
            out = F.when(k % n == i, F.lit(v).cast("string")).otherwise(out)
        return out

    return table(spark, sf_dir, "labels").select(
        k.alias("id"),
        (F.lit(60.0) + k % 90 / 10).alias("lat"),
        (F.lit(-150.0) - k % 70 / 10).alias("lon"),
        pick(11, ["n", "w", "f", "u", "s", "g", "tw", "d", "sh", "u ", "ha"]).alias("class"),
        pick(7, [None, "y", None, "m", "y ", None, " m"]).alias("discard"),
        pick(4, ["Planet", "planet ", " DigitalGlobe", "digitalglobe"]).alias("image_source"),
    )


def composite_counts(spark, sf_dir) -> DataFrame:
    """Valid-pixel counts per composite index, tile, era and epoch length."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (k % 9).cast("int").alias("idx"),
        F.floor(F.col("o_totalprice") % 1000).cast("int").alias("cnt"),
        (F.col("o_custkey") % 30).cast("int").alias("tile"),
        (k % 6 + 1).cast("int").alias("epoch_len"),
        F.when(k % 2 == 0, 1986).otherwise(2000).alias("start_year"),
    )


SQL: dict[str, str] = {
    "obs": """SELECT l_orderkey * 10 + l_linenumber AS obs_id,
      CAST(floor(l_partkey / 50) AS INT) AS row, CAST(l_partkey % 50 AS INT) AS col,
      CASE l_returnflag WHEN 'R' THEN 'LC08' WHEN 'A' THEN 'LE07' ELSE 'LT05' END AS sensor,
      l_shipdate AS ts, CAST(year(l_shipdate) AS INT) AS yr, CAST(dayofyear(l_shipdate) AS INT) AS doy,
      CAST(floor(l_quantity) AS INT) AS b1, CAST(round(l_discount * 100) AS INT) AS b2,
      CAST(round(l_tax * 100) AS INT) AS b3, CAST(floor(l_extendedprice) % 1000 AS INT) AS b4,
      CAST(l_suppkey % 100 AS INT) AS b5, CAST(l_linenumber * 10 AS INT) AS b7,
      CAST(l_orderkey % 64 AS INT) AS qa FROM lineitem""",
    "dem": """SELECT CAST(floor(p_partkey / 50) AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col,
      CAST(p_size AS DOUBLE) * 25 AS z, CAST(floor(p_retailprice) AS INT) AS v, p_size AS cls FROM part""",
    "samples": """SELECT c_custkey AS obs_pt, 1e6 + (c_custkey % 50) * 30 + 7 AS x,
      1200000e0 - floor(c_custkey / 50) * 30 - 7 AS y,
      CAST(floor(c_custkey / 50) AS INT) AS row, CAST(c_custkey % 50 AS INT) AS col,
      c_mktsegment AS segment, c_nationkey AS zone, CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS target,
      c_acctbal AS val FROM customer""",
    "sets": f"""SELECT s_suppkey AS set_id, 1e6 + (s_suppkey % 8) * 150 AS ul_x,
      1200000e0 - floor(s_suppkey / 8) * {SET_STEP} AS ul_y, 1e6 + (s_suppkey % 8) * 150 + 450 AS lr_x,
      1200000e0 - floor(s_suppkey / 8) * {SET_STEP} - 450 AS lr_y, CAST(s_suppkey * 7 % 101 AS INT) AS oob_rate,
      CAST(s_suppkey * 5 % 17 AS INT) AS imp_0, CAST(s_suppkey * 3 % 17 AS INT) AS imp_1,
      CAST(s_suppkey * 11 % 17 AS INT) AS imp_2 FROM supplier""",
    "tiles": """SELECT s_suppkey - 1 AS tile_id, s_name AS name, s_nationkey % 5 AS region_id,
      1e6 + ((s_suppkey - 1) % 10) * 150 AS ul_x, 1200000e0 - floor((s_suppkey - 1) / 10) * 150 AS ul_y,
      1e6 + ((s_suppkey - 1) % 10) * 150 + 150 AS lr_x, 1200000e0 - floor((s_suppkey - 1) / 10) * 150 - 150 AS lr_y
      FROM supplier""",
    "zone_edges": " UNION ALL ".join(
        f"SELECT tile_id, region_id, ul_x + {a[0]} AS x1, ul_y + {a[1]} AS y1, ul_x + {b[0]} AS x2, ul_y + {b[1]} AS y2 FROM tiles"
        for ring in ZONE_RINGS
        for a, b in zip(ring, ring[1:] + ring[:1])
    ),
    "predictions": """SELECT CAST(floor(l_partkey / 50) AS INT) AS row, CAST(l_partkey % 50 AS INT) AS col,
      CAST(l_suppkey AS INT) AS set_id, l_linenumber AS pred,
      CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS pred_nd FROM lineitem""",
    "pairs": "SELECT doc_id AS id, quality AS truth, toxic AS pred FROM labels",
    "probs": """SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS truth,
      CAST(floor(l_quantity) AS INT) * 2 AS prob100, CAST(floor(l_quantity) AS INT) AS score,
      l_suppkey AS set_id FROM lineitem""",
    "task_events": """SELECT event_id, ts, user_id AS task_id,
      CASE event_type WHEN 'signup' THEN 'READY' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED'
      WHEN 'error' THEN 'FAILED' ELSE 'INFO' END AS state FROM events""",
    "label_points": """SELECT doc_id AS id, 60e0 + doc_id % 90 / 10 AS lat, -150e0 - doc_id % 70 / 10 AS lon,
      CASE doc_id % 11 WHEN 0 THEN 'n' WHEN 1 THEN 'w' WHEN 2 THEN 'f' WHEN 3 THEN 'u' WHEN 4 THEN 's'
        WHEN 5 THEN 'g' WHEN 6 THEN 'tw' WHEN 7 THEN 'd' WHEN 8 THEN 'sh' WHEN 9 THEN 'u ' ELSE 'ha' END AS class,
      CASE doc_id % 7 WHEN 1 THEN 'y' WHEN 3 THEN 'm' WHEN 4 THEN 'y ' WHEN 6 THEN ' m' END AS discard,
      CASE doc_id % 4 WHEN 0 THEN 'Planet' WHEN 1 THEN 'planet ' WHEN 2 THEN ' DigitalGlobe'
        ELSE 'digitalglobe' END AS image_source FROM labels""",
    "composite_counts": """SELECT CAST(o_orderkey % 9 AS INT) AS idx,
      CAST(floor(o_totalprice % 1000) AS INT) AS cnt, CAST(o_custkey % 30 AS INT) AS tile,
      CAST(o_orderkey % 6 + 1 AS INT) AS epoch_len,
      CASE WHEN o_orderkey % 2 = 0 THEN 1986 ELSE 2000 END AS start_year FROM orders""",
}


def with_views(names: str, body: str) -> str:
    """Oracle SQL: the named derived tables as CTEs, then ``body`` (a SELECT or further CTEs, after the word RECURSIVE if they are)."""
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split())
    body, head = body.strip(), "WITH"
    if body.startswith("RECURSIVE "):
        body, head = body.removeprefix("RECURSIVE ").strip(), "WITH RECURSIVE"
    joiner = "\n" if body.upper().startswith("SELECT") else ",\n"
    return f"{head} {ctes}{joiner}{body}"
