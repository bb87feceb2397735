"""Line dedup by content-defined line chunks, in DataFrame functions alone.

A hash over the hashes of a few neighbouring lines rolls over every line.
Windows that occur before (by doc_id, then place) run together into chunks
along the text of their first occurrence; where such a run starts and ends is
set by the lines in it alone, so an inserted line shifts no other boundary. A chunk
is removed where its bytes are those of the first occurrence. Window hashes are
grouped without their texts; only the texts of repeated chunks travel, once
each, to the documents that repeat them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.tables import saved

#: Lines of a window; two lines are one, too, with so many characters.
WINDOW, LONG = 3, 200


def _lines(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))


def _windows(lines: Column, long: int) -> Column:
    """Windows as structs of their place (first line << 31 | line after the last, lines from 0) and hash.

    At each line two lines, where they are long together, and three, where not
    each two of them are (then the two windows of two say the same).
    """
    marks = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("d"), F.char_length(x).alias("n")))

    def at(m: Column, i: Column) -> Column:
        def digest(k: int) -> Column:
            return F.get(m, i + k)["d"]

        def both(k: int) -> Column:
            return F.coalesce(F.get(m, i + k)["n"] + F.get(m, i + k + 1)["n"] + 1 >= long, F.lit(False))

        def window(n: int) -> Column:
            place = F.shiftleft(i.cast("bigint"), 31).bitwiseOR((i + n).cast("bigint"))
            return F.struct(place.alias("chunk"), F.xxhash64(*map(digest, range(n))).alias("hash"))

        pair = F.when(both(0), window(2))
        triple = F.when((i + WINDOW <= F.size(m)) & ~(both(0) & both(1)), window(WINDOW))
        return F.filter(F.array(pair, triple), lambda w: w.isNotNull())

    named = F.array(F.struct(marks.alias("m")))
    return F.flatten(F.flatten(F.transform(named, lambda z: F.transform(z["m"], lambda x, i: at(z["m"], i)))))


def _pack(first: Column, after: Column) -> Column:
    return F.shiftleft(first.cast("bigint"), 31).bitwiseOR(after.cast("bigint"))


def _first(chunk: Column) -> Column:
    return F.shiftright(chunk, 31).cast("int")


def _after(chunk: Column) -> Column:
    return chunk.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def _slice(lines: Column, chunk: Column) -> Column:
    return F.slice(lines, _first(chunk) + 1, _after(chunk) - _first(chunk))


def _runs(found: Column) -> Column:
    """Chunks of (first_row, shift, chunk) windows in order: those that touch, along one shift against one text."""
    def joins(z: Column, i: Column) -> Column:
        """Whether window i goes on where the one before is."""
        one, two = F.get(z, i - 1), F.get(z, i)
        return F.coalesce((one["first_row"] == two["first_row"]) & (one["shift"] == two["shift"])
                          & (_first(two["chunk"]) <= _after(one["chunk"])), F.lit(False))

    def cut(z: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(z) - 1)
        starts, ends = F.filter(places, lambda i: ~joins(z, i)), F.filter(places, lambda i: ~joins(z, i + 1))
        return F.zip_with(starts, ends, lambda a, e: F.struct(
            F.get(z, a)["first_row"].alias("first_row"), F.get(z, a)["shift"].alias("shift"),
            _pack(_first(F.get(z, a)["chunk"]), _after(F.get(z, e)["chunk"])).alias("chunk")))

    return F.flatten(F.transform(F.array(F.struct(found.alias("z"))), lambda s: cut(s["z"])))


def dedup(docs: DataFrame, long: int = LONG) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_lines, n_removed (lines), text (what is left).

    A line goes if a window that holds it occurs before; a window that overlaps
    its own first occurrence does not count. Each different line stays where it is first. Null and
    empty texts have no lines and stay empty. Rows of equal id and text are one
    document, each with the same result. A null id comes before all others;
    other columns are not read; an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))).alias("row"),
                       text.alias("text"))
    split = rows.withColumn("lines", _lines(F.col("text")))
    places = saved(split.select("doc_id", "row", F.explode(_windows(F.col("lines"), long)).alias("c"))
                   .select("doc_id", "row", "c.chunk", "c.hash"))
    # counted before the shuffle; a hash that occurs once needs no more
    first = (places.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "chunk")).alias("first"))
             .where("n > 1").select("hash", F.col("first.row").alias("first_row"), F.col("first.chunk").alias("first_chunk")))
    again = (places.join(first, "hash")
             .where((F.col("row") != F.col("first_row")) | (_first(F.col("chunk")) >= _after(F.col("first_chunk"))))
             .select("row", F.struct("first_row", (_first(F.col("chunk")) - _first(F.col("first_chunk"))).alias("shift"), "chunk").alias("w")))
    # as many windows as a text has, without their texts
    runs = saved(again.groupBy("row").agg(F.array_sort(F.collect_set("w")).alias("z"))
                 .select("row", F.explode(_runs(F.col("z"))).alias("r")).select("row", "r.first_row", "r.shift", "r.chunk")
                 .withColumn("first_chunk", _pack(_first(F.col("chunk")) - F.col("shift"), _after(F.col("chunk")) - F.col("shift"))))
    # one exchange of the texts by row serves both joins
    texts = rows.select("row", "text")
    wanted = runs.groupBy("first_row").agg(F.collect_set("first_chunk").alias("wanted"))
    kept = (texts.join(wanted, texts["row"] == wanted["first_row"]).dropDuplicates(["first_row"])
            .withColumn("lines", _lines(F.col("text")))
            .select("first_row", F.explode(F.transform("wanted", lambda w: F.struct(w.alias("first_chunk"), F.array_join(
                _slice(F.col("lines"), w), "\n").alias("bytes")))).alias("k")).select("first_row", "k.first_chunk", "k.bytes"))
    against = (runs.join(kept, ["first_row", "first_chunk"]).groupBy("row").agg(F.collect_list(F.struct("chunk", "bytes")).alias("against"))
               .withColumnRenamed("row", "__row"))
    joined = rows.join(against, rows["row"] == against["__row"], "left").withColumn("lines", _lines(F.col("text")))
    same = F.transform(F.filter(F.coalesce("against", F.array().cast("array<struct<chunk:bigint,bytes:string>>")),
                                lambda a: F.array_join(_slice(F.col("lines"), a["chunk"]), "\n") == a["bytes"]), lambda a: a["chunk"])
    gone = F.array_distinct(F.flatten(F.transform(same, lambda c: F.sequence(_first(c), _after(c) - 1))))
    out = joined.withColumn("gone", gone)
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.when(F.size("gone") == 0, F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), left.alias("text"))


#: The same in SQL over the documents table (ids are unique there).
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, i, ls[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
        FROM documents WHERE text <> '')
), near AS (
  SELECT *, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), marked AS (
  SELECT *, coalesce(length(line) + length(b) + 1 >= {LONG}, false) AS pair,
         coalesce(length(b) + length(c) + 1 >= {LONG}, false) AS after FROM near
), windows AS (
  SELECT doc_id, i, 2 AS n, line || chr(10) || b AS bytes FROM marked WHERE pair
  UNION ALL
  SELECT doc_id, i, 3 AS n, line || chr(10) || b || chr(10) || c AS bytes FROM marked
  WHERE c IS NOT NULL AND NOT (pair AND after)
), firsts AS (
  SELECT doc_id, i, n, first_value(doc_id) OVER v AS first_id, first_value(i) OVER v AS first_i
  FROM windows WINDOW v AS (PARTITION BY n, bytes ORDER BY doc_id, i)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM firsts WHERE doc_id <> first_id OR i >= first_i + n
), texts AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(t.n_removed, 0)::BIGINT AS n_removed,
       coalesce(t.text, '') AS text
FROM documents d LEFT JOIN texts t ON t.doc_id = d.doc_id
"""
