"""Discussion threads: parsed JSON listings and turn tables, rendered as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import strip, unescape

MOST_COMMENTS, MOST_DEPTH = 40, 4
REMOVED = ("[deleted]", "[removed]")


def comments(threads: DataFrame, key: str = "doc_id", json: str = "json") -> DataFrame:
    """doc_id, path (its order in the tree), depth, author, score, body of every comment, to a depth of five levels.

    Level by level the replies of a level are taken apart as variants; there are as many steps as levels, however
    large a thread is. The second listing of a thread's JSON holds the comments.
    """
    level = threads.select(key, F.try_variant_get(F.try_parse_json(json), "$[1].data.children", "variant").alias("children"), F.lit("").alias("path"))
    found = None
    for depth in range(MOST_DEPTH + 1):
        level.createOrReplaceTempView("docmill_level")
        nodes = level.sparkSession.sql(f"SELECT t.{key}, t.path, v.pos, v.value FROM docmill_level t, LATERAL variant_explode(t.children) v")
        get = lambda p, kind: F.try_variant_get("value", p, kind)
        nodes = nodes.filter(get("$.kind", "string") == "t1").withColumn("path", F.concat("path", F.lpad(F.col("pos").cast("string"), 6, "0"), F.lit(".")))
        here = nodes.select(
            key, "path", F.lit(depth).alias("depth"), F.coalesce(get("$.data.author", "string"), F.lit("[deleted]")).alias("author"),
            F.when(F.schema_of_variant(F.try_variant_get("value", "$.data.score", "variant")) == "BIGINT", get("$.data.score", "long")).alias("score"),
            strip(F.coalesce(get("$.data.body", "string"), F.lit(""))).alias("body"))
        found = here if found is None else found.unionByName(here)
        level = nodes.select(key, F.try_variant_get("value", "$.data.replies.data.children", "variant").alias("children"), "path")
    return found


def render_comments(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, comments: the first forty comments in tree order that say something, quoted by depth."""
    order = Window.partitionBy(key).orderBy("path")
    said = rows.filter((F.col("body") != "") & ~F.col("body").isin(*REMOVED)).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= MOST_COMMENTS)
    prefix = F.repeat(F.lit("> "), F.col("depth").cast("int") + 1)
    head = F.concat(prefix, F.lit("**u/"), "author", F.lit("**"), F.coalesce(F.concat(F.lit(" ("), F.col("score").cast("string"), F.lit(" points)")), F.lit("")))
    quoted = F.array_join(F.transform(F.split("body", "\n", -1), lambda x: F.concat(F.repeat(F.lit("> "), F.col("depth").cast("int") + 1), x)), "\n")
    block = F.concat_ws("\n", head, prefix, quoted)
    return said.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("comments"))


def render_threads(threads: DataFrame, key: str = "doc_id", json: str = "json") -> DataFrame:
    """doc_id, markdown, title, author, publication_date, images of thread JSON."""
    post = F.try_variant_get(F.try_parse_json(json), "$[0].data.children[0].data", "variant")
    get = lambda p, kind: F.try_variant_get("post", p, kind)
    whole = lambda p: F.when(F.schema_of_variant(F.try_variant_get("post", p, "variant")) == "BIGINT", get(p, "long"))
    link = F.coalesce(F.nullif(get("$.url_overridden_by_dest", "string"), F.lit("")), get("$.url", "string"), F.lit(""))
    image = F.coalesce(link.rlike(r"(?i)\.(jpg|jpeg|png|gif|webp)(\?|$)"), F.lit(False))
    author = F.coalesce(get("$.author", "string"), F.lit("[deleted]"))
    media = F.map_values(get("$.media_metadata", "map<string,struct<s:struct<u:string,gif:string>>>"))
    gallery = F.filter(F.transform(media, lambda m: unescape(F.coalesce(m["s"]["u"], m["s"]["gif"]))), lambda u: u.isNotNull())
    title = F.coalesce(get("$.title", "string"), F.lit("Thread"))
    bits = F.concat_ws(
        " • ", F.when(get("$.subreddit_name_prefixed", "string") != "", F.concat(F.lit("Posted in "), get("$.subreddit_name_prefixed", "string"))),
        F.concat(F.lit("by u/"), author), F.concat(whole("$.score"), F.lit(" points")), F.concat(whole("$.num_comments"), F.lit(" comments")))
    text = F.nullif(strip(F.coalesce(get("$.selftext", "string"), F.lit(""))), F.lit(""))
    linked = F.when(~F.coalesce(get("$.is_self", "boolean"), F.lit(True)) & (link != "") & ~image, F.concat(F.lit("**Link:** "), link))
    posts = threads.select(key, json, post.alias("post")).filter(F.col("post").isNotNull())
    out = posts.join(render_comments(comments(threads, key, json), key), key, "left")
    markdown = F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.concat(F.lit("*"), bits, F.lit("*")), linked, text, F.concat(F.lit("## Comments\n\n"), F.col("comments")))
    return out.select(
        key, markdown.alias("markdown"), title.alias("title"), author.alias("author"),
        F.date_format(F.timestamp_seconds(get("$.created_utc", "double")), "yyyy-MM-dd").alias("publication_date"),
        F.concat(F.when(image, F.array(link)).otherwise(F.array().cast("array<string>")), F.coalesce(gallery, F.array().cast("array<string>"))).alias("images"))


def turns_as_comments(turns: DataFrame) -> DataFrame:
    """A turn table (conv_id, turn, role, text) as a chain of comments, each a level deeper, to the deepest level."""
    return turns.select(
        F.col("conv_id").alias("doc_id"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("path"), F.least(F.col("turn"), F.lit(MOST_DEPTH)).cast("int").alias("depth"),
        F.col("role").alias("author"), F.lit(None).cast("long").alias("score"), strip(F.col("text")).alias("body"))
