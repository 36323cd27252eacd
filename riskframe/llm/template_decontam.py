"""Benchmark decontamination by templates, with DataFrame functions only.

Words are cut at white space and stripped of punctuation at both ends.  Numbers, capitalised
words and units after a number become typed placeholders; windows of such template words are
hash-joined with those of the benchmark; a value of the item must then have the same value of the
document wherever it stands, so a question with other numbers or names is found and an unrelated
text of the same shape is not.  Numbers or names in a row are one placeholder.  Items without
such a window are searched word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import renamed_input, written

WINDOW = 8
#: Words in a window that must not be placeholders.
LITERALS = 4
#: Windows of an item that must match at one alignment (half of the item's, if that is less).
MATCHES = 6
#: Benchmark windows up to which they are broadcast (about 200 bytes each); beyond, a shuffle join.
BROADCAST_WINDOWS = 100_000
#: Share of an item's windows that must be left if values contradict each other in others.
CONSISTENT = 2 / 3

# Unit words recognised after a number.
UNITS = ("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hrs hour hours day days week weeks month months year years "
         "minute minutes second seconds meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams "
         "kilogram kilograms liter liters litre litres dollar dollars euro euros cent cents percent pound pounds mph kmh").split()
# A number or a name as a whole word of words joined by one space.
_NUMBER = r"(^| )[$€£+-]?[0-9]+(?:[.,:/][0-9]+)*%?(?= |$)"
_NAME = r"(^| )\p{Lu}\p{L}*(?= |$)"
#: Scripts written without spaces: each character is a word.  None has characters below U+0E00; the
#: range is asked first, since a script's test is slow.
_UNSPACED = r"([\u0E00-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]])"


def words(text: Column) -> Column:
    """Words without punctuation at their ends; those of punctuation only are dropped."""
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), _UNSPACED, " $1 ")
    parts = F.split(F.regexp_replace(apart, r"(?U)(^|[\s])[^\w$€£+\s-]+|[^\w%\s]+(?=\s|$)", " "), r"(?U)\s+")
    return F.filter(parts, lambda w: w != "")


def with_template(df: DataFrame, text: str, ws: str, out: str) -> DataFrame:
    """Adds the words and the template words: <num>, <name>, <unit> or the word in lower case.
    The steps are columns, since an array expression named inside a lambda would be computed
    again for each element."""
    df = df.withColumn(ws, words(F.col(text)))
    # numbers and names are replaced in the words joined again: two passes over a text, not two a word
    kinds = F.lower(F.regexp_replace(F.regexp_replace(F.array_join(ws, " "), _NUMBER, "$1<num>"), _NAME, "$1<name>"))
    df = df.withColumn("_kind", F.when(F.size(ws) == 0, F.array().cast("array<string>")).otherwise(F.split(kinds, " ")))
    is_unit = lambda t, i: (i > 0) & (F.get("_kind", i - 1) == "<num>") & t.isin(UNITS)
    return df.withColumn(out, F.transform("_kind", lambda t, i: F.when(is_unit(t, i), F.lit("<unit>")).otherwise(t))).drop("_kind")


def _runs(df: DataFrame, types: str) -> DataFrame:
    """Adds _run: (t, at) of each template word, numbers or names in a row as one, at its first word."""
    first = lambda t, i: (i == 0) | ~t.isin("<num>", "<name>") | (t != F.get(types, i - 1))
    marked = F.transform(types, lambda t, i: F.struct(t.alias("t"), i.alias("at"), first(t, i).alias("first")))
    return df.withColumn("_run", F.filter(marked, lambda x: x["first"]))


def _run_words(ws: str) -> Column:
    """The words of each run."""
    return F.transform("_run", lambda x, k: F.slice(ws, x["at"] + 1, F.coalesce(F.get("_run", k + 1)["at"], F.size(ws)) - x["at"]))


def _windows(hashes: Column, n: int, keep: Column | None = None) -> Column:
    """(pos, h) of each window of n values."""
    return F.filter(F.transform(hashes, lambda h, i: F.struct(i.alias("pos"), F.when(i <= F.size(hashes) - n, F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, n)])).alias("h"))), lambda x: x["h"].isNotNull())


def _slots(z: Column, first: Column, last: Column) -> Column:
    """(t, a, b) of the words at a placeholder, item against document.  At the ends of the item the
    document's run may go on beyond it; what differs there binds nothing (a is null)."""
    t, a, b = z["it"], z["iw"], z["dw"]
    single = lambda x, y: F.struct(t.alias("t"), x.alias("a"), y.alias("b"))
    each = lambda x, y: F.zip_with(x, y, single)
    longer = F.size(b) > F.size(a)
    beyond = (first & longer & (F.slice(b, -F.size(a), F.size(a)) == a)) | (last & longer & (F.slice(b, 1, F.size(a)) == a))
    return (F.when(~t.startswith("<"), F.array().cast("array<struct<t:string,a:string,b:string>>")).when(F.size(a) == F.size(b), each(a, b)).when(beyond, each(a, a))
            .when(first | last, F.array(single(F.lit(None).cast("string"), F.lit(None).cast("string")))).otherwise(F.array(single(F.array_join(a, " "), F.array_join(b, " ")))))


def _word_by_word(base: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """id, row, item of the items (item, iw) whose words stand in a document in a row: found by their
    first words, ``window`` at most, and then compared in full."""
    items = items.withColumn("n", F.least(F.size("iw"), F.lit(window))).withColumn("h", F.xxhash64(F.slice("iw", 1, F.col("n"))))
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())
    if not lengths:
        return base.select("id", "row").crossJoin(items.select("item")).limit(0)
    split = base.select("id", "row", words(F.col("text")).alias("dw"))
    of = lambda n: F.transform("dw", lambda _, i: F.when(i <= F.size("dw") - n, F.struct(i.alias("pos"), F.xxhash64(F.slice("dw", i + 1, n)).alias("h"))))
    starts = F.flatten(F.array(*[of(n) for n in lengths]))
    at = split.select("id", "row", F.explode(F.filter(starts, lambda x: x.isNotNull())).alias("w")).select("id", "row", "w.pos", "w.h")
    keys = items.select("h").distinct()
    if keys.count() <= BROADCAST_WINDOWS:
        keys = F.broadcast(keys)
    hit = at.join(keys, "h").distinct().alias("h")
    found = split.alias("b").join(hit, (F.col("b.row") == F.col("h.row")) & F.col("b.id").eqNullSafe(F.col("h.id"))).select("b.id", "b.row", "b.dw", "h.pos", "h.h")
    return found.join(items, "h").filter(F.slice("dw", F.col("pos") + 1, F.size("iw")) == F.col("iw")).select("id", "row", "item").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", window: int = WINDOW, literals: int = LITERALS, matches: int = MATCHES) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: the id, item id, row (hash of id
    and text), n_windows (matching windows at the best alignment), exact (all slots equal).

    A pair is reported if at least ``matches`` windows of the item match (or half of them, whichever
    is less), in order and near each other, and each slot value of the item has one value there.
    Where one has several, all windows with it are left out; then CONSISTENT of the item's windows
    must remain as well.  Items of fewer than ``window`` words, or without a window that holds
    ``literals`` plain words, are reported where their words stand in a row (n_windows 1).

    Defined cases: null or empty texts, and items without words, match nothing; windows with fewer
    than ``literals`` plain words are left out; repeated rows are reported once per id and text;
    repeated items count as items of their own; rows with a null id or item id are reported with
    it; empty tables give an empty result; further columns are not read.
    """
    items = _runs(with_template(renamed_input(benchmark, item=item_col, text=item_text_col), "text", "iw", "it"), "it")
    items = items.withColumn("it", F.transform("_run", lambda x: x["t"])).withColumn("ih", F.transform("it", lambda t: F.xxhash64(t)))
    plain = lambda p: F.size(F.filter(F.slice("it", p + 1, window), lambda t: ~t.startswith("<")))
    items = items.withColumn("w", F.filter(_windows(F.col("ih"), window), lambda x: plain(x["pos"]) >= literals))
    # written, else the filters below would compute the words anew in every expression
    items = written(items.withColumn("rw", _run_words("iw")).select("item", "iw", "it", "w", "rw"), "items")
    whole = items.filter((F.size("w") == 0) & (F.size("iw") > 0)).select("item", "iw")
    items = items.filter(F.size("w") > 0).withColumn("iw", F.col("rw")).withColumn("n_w", F.size("w")).withColumn("n_t", F.size("it"))
    items = items.withColumn("need", F.least(F.lit(matches), F.ceil(F.col("n_w") / 2)).cast("int"))
    items = items.select("item", "need", "n_w", "n_t", F.explode(F.transform("w", lambda x: F.struct(x["pos"].alias("ipos"), x["h"].alias("h"), F.slice("iw", x["pos"] + 1, window).alias("iw"), F.slice("it", x["pos"] + 1, window).alias("it")))).alias("w")).select("item", "need", "n_w", "n_t", "w.*")
    keys = items.select("h").distinct()
    if keys.count() <= BROADCAST_WINDOWS:
        keys = F.broadcast(keys)
    base = renamed_input(docs, id=id_col, text=text_col).withColumn("row", F.xxhash64("id", "text"))
    hashed = _runs(with_template(base, "text", "dw", "dt"), "dt").select("id", "row", F.transform("_run", lambda x: F.xxhash64(x["t"])).alias("th"))
    at = hashed.select("id", "row", F.explode(_windows(F.col("th"), window)).alias("w")).select("id", "row", "w.pos", "w.h")
    hit = at.join(keys, "h").groupBy("id", "row").agg(F.collect_set(F.struct("pos", "h")).alias("hits"))
    found = base.alias("b").join(hit.alias("h"), (F.col("b.row") == F.col("h.row")) & F.col("b.id").eqNullSafe(F.col("h.id"))).select("b.id", "b.row", "b.text", "h.hits")
    found = _runs(with_template(found, "text", "dw", "dt"), "dt").withColumn("dw", _run_words("dw"))
    found = found.select("id", "row", F.explode(F.transform("hits", lambda x: F.struct(x["pos"].alias("pos"), x["h"].alias("h"), F.slice("dw", x["pos"] + 1, window).alias("dw")))).alias("x")).select("id", "row", "x.*").distinct()
    pair = found.join(items, "h").withColumn("shift", F.col("pos") - F.col("ipos"))
    zipped = F.transform(F.arrays_zip("it", "iw", "dw"), lambda z, k: _slots(z, F.col("ipos") + k == 0, F.col("ipos") + k == F.col("n_t") - 1))
    pair = pair.select("id", "row", "item", "need", "n_w", "n_t", "shift", "pos", "ipos", F.flatten(zipped).alias("slots"))
    # alignments near each other are one occurrence; a window counts once, at the alignment with the most
    of = ["id", "row", "item"]
    along = Window.partitionBy(*of).orderBy("shift")
    gap = F.col("shift") - F.lag("shift").over(along) > F.greatest(F.lit(window), F.col("n_t") / 2)
    pair = pair.withColumn("new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("occ", F.sum("new").over(along)).withColumn("at", F.count("*").over(Window.partitionBy(*of, "shift")))
    best = [F.desc("at"), F.asc("shift")]
    pair = pair.withColumn("k", F.row_number().over(Window.partitionBy(*of, "occ", "ipos").orderBy(*best))).filter("k = 1")
    pair = pair.withColumn("k", F.row_number().over(Window.partitionBy(*of, "occ", "pos").orderBy(*best))).filter("k = 1")
    # values of the item with several values in the document
    one = pair.groupBy(*of, "occ").agg(F.max("need").alias("need"), F.max("n_w").alias("n_w"), F.collect_list("slots").alias("wins"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("all"))
    same = lambda x, y: (x["t"] == y["t"]) & (x["a"] == y["a"]) & (x["b"] != y["b"])
    several = F.transform(F.filter("all", lambda x: F.exists("all", lambda y: F.coalesce(same(x, y), F.lit(False)))), lambda x: F.struct(x["t"], x["a"]))
    values = F.size(F.array_distinct(F.transform("all", lambda x: F.struct(x["t"], x["a"]))))
    one = one.withColumn("bad", F.when(values < F.size("all"), several).otherwise(F.array().cast("array<struct<t:string,a:string>>")))
    one = one.withColumn("left", F.filter("wins", lambda w: ~F.arrays_overlap(F.transform(w, lambda x: F.struct(x["t"], x["a"])), F.col("bad")))).withColumn("n", F.size("left"))
    one = one.filter((F.col("n") >= F.col("need")) & ((F.size("bad") == 0) | (F.col("n") >= CONSISTENT * F.col("n_w"))))
    one = one.withColumn("exact", F.forall("all", lambda z: F.coalesce(z["a"] == z["b"], F.lit(False))))
    one = one.select(*of, "n", "exact").unionByName(_word_by_word(base, whole, window).withColumns({"n": F.lit(1), "exact": F.lit(True)}))
    return (one.groupBy("id", "row", "item").agg(F.max("n").cast("long").alias("n_windows"), F.bool_or("exact").alias("exact"))
            .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "row", "n_windows", "exact"))
