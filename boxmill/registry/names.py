"""Name, key and date expressions over whole columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmill import functions as B
from boxmill.adapters import Tables
from boxmill.operators.validate import rule_counts
from boxmill.registry import query


@query("""SELECT page_id, regexp_extract(rtrim(url, '/'), '[^/]*$') AS base,
  regexp_replace(regexp_extract(rtrim(url, '/'), '[^/]*$'), '(.)\\.[^.]+$', '\\1') AS stem FROM pages""")
def base_names(t: Tables) -> DataFrame:
    base = B.base_name("url")
    return t.raw("pages").select("page_id", base.alias("base"), B.stem(base).alias("stem"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(concat(' ', p_name, ' (', p_type, ')/', p_brand), '[^A-Za-z0-9_\\s-]', '', 'g'),
  '[-\\s]+', '-', 'g'), '-')) AS slug FROM part""")
def slugs(t: Tables) -> DataFrame:
    name = F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_type", F.lit(")/"), "p_brand")
    return t.raw("part").select("p_partkey", B.slug(name).alias("slug"))


@query("""SELECT doc_id, concat('data/', lang, '+x y') AS prefix, concat('https://', source, '.example') AS endpoint_url, '' AS region
  FROM documents""")
def storage_options(t: Tables) -> DataFrame:
    options = F.concat(
        F.lit("region=&prefix=data%2F"), "lang", F.lit("%2Bx+y&endpoint_url=https%3A%2F%2F"), "source", F.lit(".example")
    )
    return t.raw("documents").select(
        "doc_id",
        B.storage_option(options, "prefix").alias("prefix"),
        B.storage_option(options, "endpoint_url").alias("endpoint_url"),
        B.storage_option(options, "region").alias("region"),
    )


@query("""SELECT doc_id, concat('{"lang": "', lang, '", "source": "', source, '", "text": ', CAST(to_json(text) AS VARCHAR), '}') AS attributes
  FROM documents""")
def attribute_text(t: Tables) -> DataFrame:
    """Map -> JSON text over whole document texts in several languages."""
    rows = t.raw("documents").select(
        "doc_id", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source", F.lit("text"), "text").alias("m")
    )
    return rows.select("doc_id", B.attributes_json("m").alias("attributes"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN epoch_us(o_orderdate) WHEN 1 THEN epoch_us(o_orderdate) - 10800000000
  WHEN 2 THEN epoch_us(o_orderdate) + 123000 WHEN 3 THEN epoch_us(o_orderdate) WHEN 4 THEN NULL ELSE NULL END AS micros FROM orders""")
def parsed_times(t: Tables) -> DataFrame:
    """Dates written in several ways, some of them no dates."""
    stamp = F.col("o_orderdate").cast("timestamp")
    iso, plain = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")
    text = (
        F.when(F.col("o_orderkey") % 6 == 0, F.concat(iso, F.lit("Z")))
        .when(F.col("o_orderkey") % 6 == 1, F.concat(iso, F.lit("+03:00")))
        .when(F.col("o_orderkey") % 6 == 2, F.concat(plain, F.lit(".123")))
        .when(F.col("o_orderkey") % 6 == 3, F.date_format(stamp, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 6 == 4, F.lit("12:00:00"))
        .otherwise(F.concat(F.lit("on "), iso))
    )
    rows = t.raw("orders").select("o_orderkey", text.alias("text"))
    return rows.select("o_orderkey", F.unix_micros(B.parse_time("text")).alias("micros"))


@query("""SELECT p_partkey, CASE WHEN regexp_full_match(c, '#[0-9a-fA-F]{6}') THEN lower(c) END AS color FROM (
  SELECT p_partkey, concat('#', CASE WHEN p_size > 25 THEN 'AB' ELSE 'xz' END, CAST(p_partkey + 1000 AS VARCHAR)) AS c FROM part) q""")
def hex_colours(t: Tables) -> DataFrame:
    colour = F.concat(
        F.lit("#"), F.when(F.col("p_size") > 25, "AB").otherwise("xz"), (F.col("p_partkey") + 1000).cast("string")
    )
    return t.raw("part").select("p_partkey", B.hex_colour(colour).alias("color"))


@query("""SELECT concat('images/', CASE p_size % 2 WHEN 0 THEN 'train' ELSE 'val' END, '/', p_name, '.v1.png') AS path,
  concat('labels/', CASE p_size % 2 WHEN 0 THEN 'train' ELSE 'val' END, '/', p_name, '.v1.txt') AS label_path,
  concat('labels/', CASE p_size % 2 WHEN 0 THEN 'train' ELSE 'val' END) AS folder, '.png' AS suffix, concat('2026-02/', p_name) AS placed
  FROM part""")
def label_paths(t: Tables) -> DataFrame:
    split = F.when(F.col("p_size") % 2 == 0, "train").otherwise("val")
    rows = t.raw("part").select(
        "p_name", F.concat(F.lit("images/"), split, F.lit("/"), "p_name", F.lit(".v1.png")).alias("path"),
        F.concat(F.lit("images/"), split).alias("dir"),
    )
    return rows.select(
        "path", B.label_file_path("path").alias("label_path"), B.labels_folder("dir").alias("folder"),
        B.suffix(B.base_name("path")).alias("suffix"), B.month_name("p_name", "2026-02").alias("placed"),
    )


@query("""SELECT problem, count(*) AS n_rows FROM (SELECT CASE
  WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN 'image_name is empty' WHEN l_tax > 0.07 THEN 'image_name is not a bare file name'
  WHEN l_discount > 0.09 THEN 'image_path is not absolute' WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 'split is not train, val or test'
  WHEN l_quantity > 49 THEN 'instance_shape is unknown' WHEN l_quantity < 5 THEN 'box row lacks label or corners' END AS problem
  FROM lineitem) q WHERE problem IS NOT NULL GROUP BY 1""")
def broken_rules(t: Tables) -> DataFrame:
    """Order lines as dataset rows that break the rules in various ways."""
    f, n, o = F.col("l_linestatus") == "F", F.col("l_returnflag") == "N", F.col("l_linestatus") == "O"
    name = F.concat(F.lit("i"), F.col("l_partkey").cast("string"), F.lit(".jpg"))
    rows = t.raw("lineitem").select(
        F.when(f & n, "").when(F.col("l_tax") > 0.07, F.concat(F.lit("d/"), name)).otherwise(name).alias("image_name"),
        F.when(F.col("l_discount") > 0.09, "d/x").alias("image_path"),
        F.when(o & n, "dev").otherwise("val").alias("split"),
        F.when(F.col("l_quantity") > 49, "ellipse").otherwise("box").alias("instance_shape"),
        F.when(F.col("l_quantity") >= 5, "x").alias("instance_label"),
        *[F.lit(1.0).alias(c) for c in ("bbox_x_tl", "bbox_y_tl", "bbox_x_br", "bbox_y_br")],
    )
    return rule_counts(rows)


@query("""SELECT p_partkey, concat(replace(lower(p_name), 'll', 'ss'), '/', lower(p_type)) AS key FROM part""")
def folded_names(t: Tables) -> DataFrame:
    """Names written with sharp and long s, folded."""
    name = F.translate(F.replace(F.lower("p_name"), F.lit("ll"), F.lit("ß")), "s", "ſ")
    return t.raw("part").select("p_partkey", B.folded(F.concat(name, F.lit("/"), F.upper("p_type"))).alias("key"))
