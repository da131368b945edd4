"""Recognised text blocks: filter, group by overlap, fuse, repair against known names, and assemble.

Blocks are rows of image_id, ordinal, backend, text, confidence, x, y, w, h, block_type, n_lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, fields
from ..functions import text as t
from ..plans.shared import checkpointed, shuffled
from .phrases import nearest


def accepted(blocks: DataFrame, least: float = 0.3) -> DataFrame:
    """Blocks with two characters, a letter or digit, and enough confidence."""
    text = F.trim("text")
    return blocks.filter((F.length(text) >= 2) & (F.col("confidence") >= least) & text.rlike(r"[\p{L}\p{N}]"))


def successful(results: DataFrame) -> DataFrame:
    """Backend results (image_id, backend, error, raw_text, n_blocks) without an error and with any text or block."""
    return results.filter(F.col("error").isNull() & ((F.trim(t.text_or_empty(F.col("raw_text"))) != "") | (F.col("n_blocks") > 0)))


def first_backend(results: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """The first successful backend of each image by rank."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in ranks.items() for x in p)), F.col("backend")), F.lit(len(ranks)))
    order = Window.partitionBy("image_id").orderBy(rank, "backend")
    return successful(results).withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes with columns a.x and so on."""
    area = overlap_area(a, b)
    whole = F.expr(f"{a}.w * {a}.h + {b}.w * {b}.h") - area
    return F.when(whole > 0, area / whole).otherwise(0.0)


def overlap_area(a: str, b: str) -> Column:
    wide = F.expr(f"greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))")
    high = F.expr(f"greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))")
    return wide * high


def overlaps(blocks: DataFrame, least_iou: float = 0.35, least_inside: float = 0.8) -> DataFrame:
    """image_id, a, b: pairs of ordinals a < b whose boxes overlap enough, or one lies in the other."""
    a, b = blocks.alias("a"), blocks.alias("b")
    near = (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.ordinal") < F.col("b.ordinal")) & F.expr("a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h")
    smaller = F.least(F.expr("a.w * a.h"), F.expr("b.w * b.h"))
    met = a.join(b, near).filter((iou("a", "b") >= least_iou) | (overlap_area("a", "b") >= least_inside * smaller))
    return met.select("a.image_id", F.col("a.ordinal").alias("a"), F.col("b.ordinal").alias("b"))


def overlap_groups(blocks: DataFrame, pairs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Blocks with group_id, the smallest ordinal that overlaps lead to within the image.

    Labels pass along edges and jump to their own label's label until none changes; each
    round is checkpointed. Groups never leave an image.
    """
    edges = pairs.unionByName(pairs.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
    edges = checkpointed(edges)
    labels = edges.select("image_id", F.col("a").alias("ordinal")).distinct().withColumn("label", F.col("ordinal"))
    for _ in range(most_rounds):
        seen = edges.join(labels.select("image_id", F.col("ordinal").alias("b"), F.col("label").alias("near")), ["image_id", "b"]).groupBy("image_id", F.col("a").alias("ordinal")).agg(F.min("near").alias("near"))
        stepped = labels.join(seen, ["image_id", "ordinal"]).select("image_id", "ordinal", "label", F.least("label", "near").alias("to"))
        jump = stepped.select("image_id", F.col("ordinal").alias("to"), F.col("to").alias("further"))
        moved = checkpointed(stepped.join(jump, ["image_id", "to"]).select("image_id", "ordinal", "label", F.least("to", "further").alias("new")))
        labels = moved.select("image_id", "ordinal", F.col("new").alias("label"))
        if moved.filter("new <> label").isEmpty():
            break
    else:
        raise RuntimeError(f"overlap groups did not settle in {most_rounds} rounds")
    return blocks.join(labels, ["image_id", "ordinal"], "left").withColumn("group_id", F.coalesce("label", "ordinal")).drop("label")


def block_score() -> Column:
    """Confidence with bonuses for lines and for longer text."""
    return F.round(F.col("confidence") + F.when(F.col("n_lines") > 0, 0.05).otherwise(0.0) + F.least(F.length("text") / 1000, F.lit(0.05)), 6)


def fuse(grouped: DataFrame) -> DataFrame:
    """One block for each group, in reading order.

    The winner has the best score, then lines, then length, then backend; ties go to the
    topmost, leftmost, first, then to the larger text and box. The type is the commonest known one, the larger name on a tie.
    """
    winner = F.struct(block_score().alias("score"), (F.col("n_lines") > 0).alias("lined"), F.length("text").alias("length"), F.col("backend"), (-F.col("y")).alias("up"), (-F.col("x")).alias("left"), (-F.col("ordinal")).alias("early"), F.col("text"), F.col("w"), F.col("h"))
    best = grouped.groupBy("image_id", "group_id").agg(
        F.max_by(F.struct("text", "x", "y", "w", "h"), winner).alias("best"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_blocks"),
        F.max_by("ordinal", F.struct("n_lines", "confidence", -F.col("ordinal"))).alias("richest"),
        F.array_join(F.array_sort(F.collect_set("backend")), ",").alias("backends"),
    )
    types = grouped.filter("block_type <> 'unknown'").groupBy("image_id", "group_id", "block_type").agg(F.count(F.lit(1)).alias("n"))
    mode = types.groupBy("image_id", "group_id").agg(F.max_by("block_type", F.struct("n", "block_type")).alias("block_type"))
    fused = best.join(mode, ["image_id", "group_id"], "left").select("image_id", "group_id", "best.*", "confidence", "n_blocks", "richest", F.concat(F.lit("fusion:"), "backends").alias("source"), F.coalesce("block_type", F.lit("unknown")).alias("block_type"))
    return in_reading_order(fused, "group_id")


def in_reading_order(blocks: DataFrame, tie: str = "ordinal") -> DataFrame:
    order = Window.partitionBy("image_id").orderBy("y", "x", tie)
    return blocks.withColumn("reading_order", F.row_number().over(order) - 1)


def image_text(blocks: DataFrame) -> DataFrame:
    """image_id, raw_text, confidence (the best block's), mean_confidence, n_blocks."""
    ordered = F.array_sort(F.collect_list(F.struct("reading_order", "text")))
    return blocks.groupBy("image_id").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("raw_text"), F.max("confidence").alias("confidence"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count(F.lit(1)).alias("n_blocks"))


def line_text(words: DataFrame) -> DataFrame:
    """image_id, line, text: words (image_id, line, x, w, y, text) joined without a blank where the gap is small.

    Small is 6, up to 28 between single characters and 18 between words of two.
    """
    order = Window.partitionBy("image_id", "line").orderBy("x", "y", "text", "w")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(order)
    longest = F.greatest(F.length("text"), F.length(F.lag("text").over(order)))
    small = F.when(longest <= 1, 28).when(longest <= 2, 18).otherwise(6)
    parts = words.withColumn("n", F.row_number().over(order)).withColumn("part", F.concat(F.when(gap.isNull() | (gap <= small), "").otherwise(" "), F.col("text")))
    joined = F.array_sort(F.collect_list(F.struct("n", "part")))
    return parts.groupBy("image_id", "line").agg(F.array_join(F.transform(joined, lambda s: s["part"]), "").alias("text"))


def token_variants(tokens: DataFrame, limit: int = 16) -> DataFrame:
    """token, variant, ord: the token, then spellings with lookalike letters exchanged, at most limit.

    All combinations of up to four exchangeable letters in tokens of up to four letters;
    one letter at a time in longer ones.
    """
    back = {v: k for k, v in reversed(t.LOOKALIKES.items()) if not k.isdigit()}
    swaps = t.LOOKALIKES | back
    table = F.create_map(*(F.lit(x) for p in swaps.items() for x in p))
    chars = F.filter(F.split(F.lower("token"), ""), lambda c: c != "")
    one = F.filter(F.transform(F.sequence(F.lit(1), F.length("token")), lambda k: F.concat(F.substring(F.lower("token"), F.lit(1), k - 1), F.element_at(table, F.substring(F.lower("token"), k, F.lit(1))), F.substring(F.lower("token"), k + 1, F.length("token")))), lambda v: v.isNotNull())
    grow = lambda made, c: F.flatten(F.transform(made, lambda m: F.transform(F.array_compact(F.array(c, F.element_at(table, c))), lambda x: F.concat(m, x))))
    every = F.aggregate(chars, F.array(F.lit("")), grow)
    some = F.when(F.length("token") <= 4, every).otherwise(F.concat(F.array(F.lower("token")), one))
    return tokens.select("token", F.posexplode(F.slice(F.array_distinct(some), 1, limit)).alias("ord", "variant"))


def repaired(tokens: DataFrame, most_letters: int = 6) -> DataFrame:
    """token, repaired: a short token of mixed script in its best single script, Cyrillic before Latin."""
    mixed = tokens.select("token").distinct().filter((t.script(F.col("token")) == "mixed") & (F.length("token") <= most_letters))
    kind = t.script(F.col("variant"))
    score = F.struct(F.when(kind.isin("cyrillic", "latin"), 2).when(kind == "mixed", 0).otherwise(1).alias("pure"), (kind == "cyrillic").alias("cyrillic"), F.length(F.regexp_replace("variant", r"[^\p{L}]", "")).alias("letters"), (-F.col("ord")).alias("early"))
    best = token_variants(mixed).groupBy("token").agg(F.max_by("variant", score).alias("repaired"))
    return tokens.join(best, "token", "left").withColumn("repaired", F.coalesce("repaired", "token"))


def name_keys(entities: DataFrame) -> DataFrame:
    """entity_id, entity_type, name, key, at: a row for the name and each alias (entities have aliases as an array)."""
    every = entities.select("entity_id", "entity_type", "name", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "spelling"))
    return every.select("entity_id", "entity_type", "name", "at", F.lower(F.regexp_replace("spelling", r"\s+", "")).alias("key")).filter("key <> ''")


def exact_names(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """Texts (text_id, text) whose letters without blanks equal a name or alias; the first entity wins."""
    keyed = texts.withColumn("key", F.lower(F.regexp_replace("text", r"\s+", "")))
    return keyed.join(shuffled(name_keys(entities)), "key").groupBy("text_id").agg(F.min_by("name", F.struct("entity_id", "at")).alias("name"), F.min("entity_id").alias("entity_id"))


def fuzzy_names(texts: DataFrame, entities: DataFrame, threshold: float = 0.72) -> DataFrame:
    """text_id, name, entity_id, score: the most similar name or alias, directly or by lookalike letters.

    Nothing over the threshold is lost (phrases.nearest). Equal texts are compared once.
    """
    keyed = texts.select("text_id", F.lower(F.regexp_replace("text", r"\s+", "")).alias("key")).filter("key <> ''")
    right = name_keys(entities).withColumnRenamed("key", "other")
    scored = nearest(keyed.select("key").distinct(), right.select("other").distinct(), threshold).withColumn("score", F.round("score", 6))
    best = scored.join(shuffled(right), "other").groupBy("key").agg(F.max_by(F.struct("name", "entity_id", "score"), F.struct("score", -F.col("entity_id"), -F.col("at"))).alias("best"))
    return keyed.join(best, "key").select("text_id", "best.*")


def classified(texts: DataFrame, entities: DataFrame, threshold: float = 0.74, resolve: float = 0.8) -> DataFrame:
    """texts with class (age, date, name, similar_name, unknown) and resolved, the canonical name where sure enough."""
    low = F.lower("text")
    keyed = texts.withColumn("key", F.lower(F.regexp_replace("text", r"\s+", "")))
    keys = keyed.select(F.col("key").alias("text_id"), F.col("key").alias("text")).filter("key <> ''").distinct()
    exact = exact_names(keys, entities).select(F.col("text_id").alias("key"), F.col("name").alias("exact"))
    near = fuzzy_names(keys, entities, threshold).select(F.col("text_id").alias("key"), F.col("name").alias("near"), "score")
    joined = keyed.join(near.join(exact, "key", "left"), "key", "left")  # an equal name is a near one too
    kind = F.when(fields.age_limit(F.col("text")).isNotNull(), "age").when(low.rlike(dates.DOTTED) | low.rlike(dates.WORDED), "date").when(F.col("exact").isNotNull(), "name").when(F.col("near").isNotNull(), "similar_name").otherwise("unknown")
    return joined.select(*texts.columns, kind.alias("class"), F.coalesce("exact", F.when(F.col("score") >= resolve, F.col("near")), "text").alias("resolved"))


def dictionary(descriptions: DataFrame, entities: DataFrame) -> DataFrame:
    """phrase: description lines (text), names and aliases, once each whatever the case."""
    spoken = descriptions.select(F.explode(F.split("text", "\n")).alias("phrase"), F.lit(0).alias("rank"))
    names = entities.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("phrase"), F.lit(1).alias("rank"))
    every = spoken.unionByName(names).withColumn("phrase", t.squeeze(F.col("phrase"))).filter("phrase <> ''")
    return every.groupBy(F.lower("phrase").alias("key")).agg(F.min_by("phrase", F.struct("rank", "phrase")).alias("phrase")).select("phrase")


def outcomes(results: DataFrame) -> DataFrame:
    """image_id, tried, successful, n_blocks, errors of backend results."""
    good = F.col("error").isNull() & ((F.trim(t.text_or_empty(F.col("raw_text"))) != "") | (F.col("n_blocks") > 0))
    return results.groupBy("image_id").agg(F.count(F.lit(1)).alias("tried"), F.count_if(good).alias("successful"), F.sum("n_blocks").alias("n_blocks"), F.array_join(F.array_sort(F.collect_set("error")), ",").alias("errors"))


def pipeline(blocks: DataFrame, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fused blocks and their images' texts; with entities the texts of blocks are resolved first."""
    good = accepted(blocks)
    fused = fuse(overlap_groups(good, overlaps(good)))
    if entities is not None:
        fused = classified(fused, entities).withColumn("text", F.col("resolved")).drop("resolved")
    return fused, image_text(fused)


def evidence(texts: DataFrame, fused: DataFrame) -> DataFrame:
    """image_id, kind, text, confidence: a row for each image's text and for each of its blocks."""
    whole = texts.select("image_id", F.lit("raw_text").alias("kind"), F.col("raw_text").alias("text"), "confidence")
    clean = texts.select("image_id", F.lit("normal_text").alias("kind"), t.ocr_text(F.col("raw_text")).alias("text"), "confidence")
    return whole.unionByName(clean).unionByName(fused.select("image_id", F.lit("block").alias("kind"), "text", "confidence"))


_WORD = "struct<text:string,confidence:double,bbox:array<int>>"
_LINE = f"struct<text:string,confidence:double,bbox:array<int>,words:array<{_WORD}>>"
RESULT = f"struct<backend_name:string,raw_text:string,confidence:double,blocks:array<struct<text:string,confidence:double,bbox:array<int>,lines:array<{_LINE}>,block_type:string,reading_order:int,source:string>>,metadata:map<string,string>>"


def result_json(result: Column) -> Column:
    """A recognition result, blocks of lines of words, as JSON text; missing values are left out."""
    return F.to_json(result.cast(RESULT))


def result_of(json: Column) -> Column:
    """The result that result_json() wrote; null for what is no JSON object or names no backend."""
    parsed = F.from_json(json, RESULT)
    return F.when(parsed["backend_name"].isNotNull(), parsed)


def flatten_overlay(payload: Column) -> Column:
    """array<struct<text,x,y,w,h>> of an overlay payload's lines; a line's box is the union of its words' boxes."""
    schema = "array<struct<lines:array<struct<text:string,top:int,height:int,words:array<struct<text:string,left:int,top:int,width:int,height:int>>>>>>"
    results = F.from_json(payload, schema)
    rows = F.flatten(F.transform(results, lambda r: F.coalesce(r["lines"], F.array().cast("array<struct<text:string,top:int,height:int,words:array<struct<text:string,left:int,top:int,width:int,height:int>>>>"))))

    def box(v: Column) -> Column:
        words = v["words"]
        left, top = F.array_min(F.transform(words, lambda w: w["left"])), F.array_min(F.transform(words, lambda w: w["top"]))
        right, bottom = F.array_max(F.transform(words, lambda w: w["left"] + w["width"])), F.array_max(F.transform(words, lambda w: w["top"] + w["height"]))
        return F.struct(F.coalesce(v["text"], F.array_join(F.transform(words, lambda w: w["text"]), " ")).alias("text"), F.coalesce(left, F.lit(0)).alias("x"), F.coalesce(top, v["top"]).alias("y"), F.coalesce(right - left, F.lit(0)).alias("w"), F.coalesce(bottom - top, v["height"]).alias("h"))

    return F.transform(rows, box)


def flatten_arrays(texts: Column, scores: Column, polygons: Column) -> Column:
    """array<struct<text,score,x,y,w,h>> of parallel arrays of any lengths; polygons are arrays of [x, y]; sides are 1 at least."""
    zipped = F.arrays_zip(texts.alias("text"), scores.alias("score"), polygons.alias("points"))

    def row(z: Column) -> Column:
        xs, ys = F.transform(z["points"], lambda p: p[0]), F.transform(z["points"], lambda p: p[1])
        return F.struct(z["text"].alias("text"), F.coalesce(z["score"], F.lit(0.0)).alias("score"), F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), F.greatest(F.lit(1), F.array_max(xs) - F.array_min(xs)).alias("w"), F.greatest(F.lit(1), F.array_max(ys) - F.array_min(ys)).alias("h"))

    return F.transform(F.filter(zipped, lambda z: F.coalesce(F.trim(z["text"]), F.lit("")) != ""), row)
