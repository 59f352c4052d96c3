"""Elements of one large JSON array, read by many tasks.

A file is read as pieces between commas, split wherever the file system splits
it, so a file of one line is no hindrance. What a piece does to the state of
the text (inside a string or not) and to the depth of brackets is counted for
both states it may begin in; sums over the pieces of a stretch of a split, then
over the stretches of a file, give each piece its true state, depth and number. That is a
structural index: a comma separates two elements of an array exactly if the
text is outside strings there, at the array's depth. Pieces of an element are
brought together and parsed on their own, so no value is larger than an
element, and no task reads a whole file.

Where the rows are is found on the index too, one small step per segment of a
path: a piece that begins outside strings at the depth of an object begins one
of its members. An index is a table per file, so many files are read at once.

Files hold one value each. Names in a path have no commas. Of a repeated name
the last value counts.
"""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridpress.session import stage
from gridpress.sources.jsonrows import JsonTable, flatten_rows, normalize_json, numbered

#: Begins a member of an object: its name and the colon.
_MEMBER = r'^\s*("(?:[^"\\]++|\\.)*+")\s*+:\s*+'
#: Pieces of a split that are summed in one window: 2 to this power.
STRETCH_BITS = 14
FILE, STRETCH = ["_file"], ["_file", "_block", "_stretch"]


def _turn(s: int):
    return lambda _, i: i % 2 == s


def _outside(pieces: DataFrame) -> DataFrame:
    """Add ``_q`` (quotes) and, for each state a piece may begin in, the text outside strings."""
    # An escaped character is no quote and no backslash.
    clean = F.regexp_replace("_text", r"(?s)\\.", "")
    pieces = pieces.withColumn("_parts", F.split(clean, '"', -1)).withColumn("_q", (F.size("_parts") - 1).cast("long"))
    each = {f"_out{s}": F.array_join(F.filter("_parts", _turn(s)), "") for s in (0, 1)}
    return pieces.withColumns(each).drop("_parts")


def _net(out: C) -> C:
    """By how much a text outside strings changes the depth."""
    opened = F.length(F.regexp_replace(out, r"[^\[{]", ""))
    return (opened - F.length(F.regexp_replace(out, r"[^\]}]", ""))).cast("long")


def structural_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One record per piece: ``_file``, ``_n`` (number in the file), ``_text``, ``_inside`` (state it
    begins in), ``_depth`` (before it), ``_after`` (depth after it), ``_ends_inside`` and ``_out``."""
    scan = spark.read.option("lineSep", ",").text(path)
    pieces = scan.select(
        F.col("value").alias("_text"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    ).withColumn("_id", F.monotonically_increasing_id())
    # Ids count the pieces of a split one by one, so a stretch is no longer than that, whatever the split.
    pieces = pieces.withColumn("_stretch", F.shiftright("_id", STRETCH_BITS))
    pieces = _outside(pieces).withColumns({f"_net{s}": _net(F.col(f"_out{s}")) for s in (0, 1)})
    w = W.partitionBy(*STRETCH).orderBy("_id")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    sums = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    pieces = pieces.withColumns({"_quotes": sums("_q"), "_at": F.row_number().over(w).cast("long") - 1})
    # Depths if the stretch begins outside a string, and if it begins inside.
    turned = F.col("_quotes") % 2 == 1
    net = {h: F.when(turned == F.lit(h == 1), F.col("_net0")).otherwise(F.col("_net1")) for h in (0, 1)}
    pieces = pieces.withColumns({f"_to{h}": net[h] for h in (0, 1)})
    pieces = pieces.withColumns({f"_deep{h}": sums(f"_to{h}") for h in (0, 1)})
    pieces = stage(pieces.drop("_net0", "_net1"), "pieces")

    splits = pieces.groupBy(*STRETCH).agg(
        F.sum("_q").alias("_all_q"), F.sum("_to0").alias("_all0"), F.sum("_to1").alias("_all1"), F.count(F.lit(1)).alias("_many")
    )
    earlier = W.partitionBy(*FILE).orderBy("_block", "_stretch").rowsBetween(W.unboundedPreceding, -1)
    total = lambda x: F.coalesce(F.sum(x).over(earlier), F.lit(0))
    splits = splits.withColumn("_first", total("_all_q") % 2 == 1)
    splits = splits.withColumn("_all", F.when(F.col("_first"), F.col("_all1")).otherwise(F.col("_all0")))
    splits = splits.select(*STRETCH, "_first", total("_all").alias("_base"), total("_many").alias("_offset"))

    rows = pieces.join(splits, STRETCH)
    inside = F.col("_first") != (F.col("_quotes") % 2 == 1)
    pick = lambda name: F.when(F.col("_first"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    depth = F.col("_base") + pick("_deep")
    return stage(
        rows.select(
            *STRETCH, (F.col("_offset") + F.col("_at")).alias("_n"), "_text", inside.alias("_inside"), depth.alias("_depth"),
            (depth + pick("_to")).alias("_after"), (inside != (F.col("_q") % 2 == 1)).alias("_ends_inside"),
            F.when(inside, F.col("_out1")).otherwise(F.col("_out0")).alias("_out"),
        ),
        "index",
    )


def _value_at(piece: C, skip: C) -> C:
    """Where the value that follows ``skip`` characters of a piece begins, with its first character."""
    rest = F.substring(piece, skip + 1, F.length(piece))
    start = skip + F.length(rest) - F.length(F.ltrim(F.regexp_replace(rest, r"^\s+", "")))
    return F.struct(start.alias("at"), F.substring(piece, start + 1, F.lit(1)).alias("kind"))


def _roots(index: DataFrame) -> DataFrame:
    """The value of each file: ``_n`` of its piece, ``at`` and ``kind`` of its first character, ``depth`` before it."""
    mark = F.when(F.col("_text").startswith("\ufeff"), 1).otherwise(0)
    head = index.where("_n = 0").select("_file", "_n", _value_at(F.col("_text"), mark).alias("v"))
    return head.select("_file", "_n", "v.at", "v.kind", F.lit(0).cast("long").alias("depth"), F.lit("ok").alias("status"))


def _beside(index: DataFrame, files: DataFrame) -> DataFrame:
    """Pieces with the record of their file, each where it lies: a file's pieces never meet in one task."""
    return index.join(F.broadcast(files), "_file")


def _ends(index: DataFrame, open_: DataFrame) -> DataFrame:
    """Add ``_end``, the piece in which a container closes."""
    named = open_.withColumnRenamed("_n", "_open")
    inside = _beside(index, named.select("_file", "_open", "depth")).where("_n >= _open and _after <= depth and not _ends_inside")
    return named.join(inside.groupBy("_file").agg(F.min("_n").alias("_end")), "_file", "left").withColumnRenamed("_open", "_n")


def _members(index: DataFrame, open_: DataFrame) -> DataFrame:
    """Pieces that begin a member of each container, with the characters of them that come before it."""
    named = _ends(index, open_).select("_file", F.col("_n").alias("_open"), "_end", "at", "depth")
    joined = _beside(index.select(*STRETCH, "_n", "_text", "_inside", "_depth"), named)
    first = F.col("_n") == F.col("_open")
    later = (F.col("_n") > F.col("_open")) & (F.col("_n") <= F.col("_end")) & ~F.col("_inside") & (F.col("_depth") == F.col("depth") + 1)
    return joined.where(first | later).select(*STRETCH, "_n", "_text", F.when(first, F.col("at") + 1).otherwise(0).alias("skip"), (F.col("depth") + 1).alias("depth"))


def _step(index: DataFrame, now: DataFrame, segment: str) -> DataFrame:
    """The member of each file's container that a path segment names."""
    whole = segment.lstrip("-").isdigit()
    wanted = int(segment) if whole else -1
    open_ = now.where("status = 'ok' and kind in ('{', '[')")
    members = _members(index, open_.drop("kind", "status")).withColumn("rest", F.expr("substring(_text, skip + 1)"))
    raw = F.regexp_extract("rest", _MEMBER, 1)
    name = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")[0]
    named = members.withColumn("past", F.col("skip") + F.length(F.regexp_extract("rest", _MEMBER, 0))).where((raw != "") & (name == segment))
    value = F.struct(F.col("_n"), _value_at(F.col("_text"), F.col("past")).alias("v"), F.col("depth"))
    by_name = named.groupBy("_file").agg(F.max_by(value, "_n").alias("found"))
    # Elements are counted, never numbered: the one wanted has as many before it as its index says.
    head = members.withColumn("past", F.col("skip")).where(F.lit(whole and wanted >= 0))
    here = F.row_number().over(W.partitionBy(*STRETCH).orderBy("_n")) - 1
    many = head.groupBy(*STRETCH).agg(F.count(F.lit(1)).alias("_many"))
    earlier = W.partitionBy(*FILE).orderBy("_block", "_stretch").rowsBetween(W.unboundedPreceding, -1)
    many = many.select(*STRETCH, F.coalesce(F.sum("_many").over(earlier), F.lit(0)).alias("_before"))
    head = head.withColumn("_here", here).join(many, STRETCH).where((F.col("_before") + F.col("_here") == wanted) & (F.regexp_replace("rest", r"[\s\]]", "") != ""))
    by_place = head.groupBy("_file").agg(F.first(value).alias("entry"))
    joined = now.select("_file", "kind", "status").join(by_name, "_file", "left").join(by_place, "_file", "left")
    hit = F.when(F.col("kind") == "{", F.col("found")).when(F.col("kind") == "[", F.col("entry"))
    failure = (
        F.when(F.col("kind") == "{", F.when(hit.isNull(), F.lit("missing-key")))
        .when(F.col("kind") == "[", F.when(hit.isNull(), F.lit("index-out-of-range" if whole else "missing-key")))
        .otherwise(F.lit("not-an-object"))
    )
    status = F.when(F.col("status") == "ok", F.coalesce(failure, F.lit("ok"))).otherwise(F.col("status"))
    step = joined.select("_file", hit.alias("hit"), status.alias("status"))
    return stage(step.select("_file", "hit._n", "hit.v.at", "hit.v.kind", "hit.depth", "status"), "step")


def _wrapped(index: DataFrame, roots: DataFrame) -> DataFrame:
    """The first array among the members of each file's object, or the object itself as a single row."""
    # Without strings a member that opens an array reads ":[", whatever its name holds.
    opens = F.col("_out").rlike(r"^\s*+(\{\s*+)?:\s*+\[") & F.when(F.col("_n") == 0, F.col("_out").rlike(r"^\s*+\{")).otherwise(F.col("_depth") == 1)
    first = index.where(opens).groupBy("_file").agg(F.min_by(F.struct("_n", "_text", "_inside"), "_n").alias("m"))
    # The bracket is the first one after the colon that closes the name.
    text, chars = F.col("m._text"), r'(?:[^"\\]++|\\.)*+"'
    continued, begun = (F.length(F.regexp_extract(text, p + chars + r"\s*+:\s*+", 0)) for p in ("^", r'^\s*+\{?\s*+"'))
    at = F.when(F.col("m._inside"), continued).otherwise(begun)
    found = first.select("_file", F.struct(F.col("m._n"), at.alias("at")).alias("m"))
    joined = roots.join(found, "_file", "left")
    inner = (F.col("kind") == "{") & F.col("m").isNotNull()
    return joined.select(
        "_file", F.when(inner, F.col("m._n")).otherwise(F.col("_n")).alias("_n"), F.when(inner, F.col("m.at")).otherwise(F.col("at")).alias("at"),
        F.when(inner, F.lit("[")).otherwise(F.col("kind")).alias("kind"), F.when(inner, F.lit(1)).otherwise(F.col("depth")).cast("long").alias("depth"), "status",
    )


def array_rows(spark: SparkSession, path: str | list[str], json_path: str | None = None, any_shape: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON files: ``_file``, ``_pos``, ``_t``, ``_v`` of each element, and ``_file``, ``status``.

    ``any_shape`` without a path takes an array, an object around an array, or
    an object as one row; otherwise the value, or what the dotted path names
    in it, must be an array. A file with an element that is no JSON is refused.
    """
    index = structural_index(spark, path)
    segments = [s.strip() for s in (json_path or "").split(".") if s.strip()]
    if any("," in s for s in segments):
        raise ValueError("names in a path may not hold commas")
    now = _roots(index)
    if any_shape and not segments:
        now = _wrapped(index, now)
    for segment in segments:
        now = _step(index, now, segment)
    single = (F.col("kind") == "{") & F.lit(any_shape and not segments)
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("kind").isin("[") | single, F.lit("ok"))
    now = now.withColumn("status", F.coalesce(status, F.lit("not-rows" if any_shape and not segments else "not-an-array")))
    now = stage(_ends(index, now.withColumn("single", single)), "target")

    # An element's pieces are those since the last separating comma; a single object is all of its pieces.
    target = now.where("status = 'ok'").select("_file", F.col("_n").alias("_open"), "_end", "at", "depth", "single")
    rows = _beside(index, target).where("_n between _open and _end")
    comma = ~F.col("single") & (F.col("_n") < F.col("_end")) & ~F.col("_ends_inside") & (F.col("_after") == F.col("depth") + 1)
    from_ = F.when(F.col("_n") == F.col("_open"), F.col("at") + F.when(F.col("single"), 0).otherwise(1)).otherwise(0)
    rows = rows.select(*STRETCH, "_n", "_end", "depth", "_after", "single", F.expr("_text").alias("_text"), from_.cast("int").alias("_from"), comma.cast("long").alias("_comma"))
    # The last piece ends before the bracket that closes the array: of its closing brackets those of deeper levels stay.
    closers = F.regexp_extract("_text", r"([\]}\s]*+)$", 1)
    deeper = F.length(F.regexp_replace(closers, r"\s", "")) - (F.col("depth") - F.col("_after")) - F.when(F.col("single"), 0).otherwise(1)
    kept = F.concat(F.expr("substring(_text, _from + 1, length(_text) - _from - length(_tail))"), F.substring(F.regexp_replace("_tail", r"\s", ""), F.lit(1), deeper.cast("int")))
    text = F.when(F.col("_n") == F.col("_end"), kept).otherwise(F.expr("substring(_text, _from + 1)"))
    rows = rows.withColumn("_tail", closers).withColumn("_part", text)
    w = W.partitionBy(*STRETCH).orderBy("_n")
    rows = stage(rows.select(*STRETCH, "_n", "_part", "_comma", F.coalesce(F.sum("_comma").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_seen")), "parts")
    earlier = W.partitionBy(*FILE).orderBy("_block", "_stretch").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*STRETCH).agg(F.sum("_comma").alias("_commas"))
    counts = counts.select(*STRETCH, F.coalesce(F.sum("_commas").over(earlier), F.lit(0)).alias("_offset"))
    placed = rows.join(counts, STRETCH).withColumn("_pos", F.col("_offset") + F.col("_seen"))
    whole = placed.groupBy("_file", "_pos").agg(F.array_sort(F.collect_list(F.struct("_n", "_part"))).alias("_parts"))
    elements = whole.select("_file", "_pos", F.regexp_replace(F.array_join("_parts._part", ","), r"^\s+|\s+$", "").alias("_t"))
    elements = stage(elements.withColumn("_v", F.try_parse_json("_t")), "elements")

    per_file = elements.groupBy("_file").agg(
        F.count(F.lit(1)).alias("many"), F.count_if(F.col("_v").isNull() & (F.col("_t") != "")).alias("bad"), F.count_if(F.col("_t") == "").alias("blank")
    )
    state = now.join(per_file, "_file", "left")
    final = (
        F.when(F.col("status") != "ok", F.col("status"))
        .when(F.col("_end").isNull() | (F.col("bad") > 0) | ((F.col("blank") > 0) & (F.col("many") > 1)), F.lit("invalid-json"))
        .when(F.col("blank") == 1, F.lit("no-rows"))
        .otherwise(F.lit("ok"))
    )
    state = stage(state.select("_file", final.alias("status")), "state")
    good = elements.join(F.broadcast(state.where("status = 'ok'").select("_file")), "_file", "left_semi")
    return good.select("_file", "_pos", "_t", "_v"), state.where("status <> 'ok'")


def read_json_files(spark: SparkSession, path: str | list[str], source: str, json_path: str | None = None, any_shape: bool = True) -> JsonTable:
    """Normalise all rows of JSON files of any size, in path and element order."""
    rows, rejects = array_rows(spark, path, json_path, any_shape)
    flat = stage(flatten_rows(rows), "json")
    return JsonTable(normalize_json(numbered(flat, "_file"), source), rejects)
