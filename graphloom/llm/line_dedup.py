"""Line deduplication, exact and near, with DataFrame functions only.

A line's form is its text trimmed of white space and lower-cased; words are split at all white space. Candidates are
lines of MIN_WORDS words or more, of MIN_CHARS characters or more, or of MIN_SIGNS or more of the scripts written without
spaces. A candidate is removed where an earlier one, by (doc_id, row, line number), has the same form, or, if both have
MIN_WORDS words or more, a form within one word edit (one word changed, inserted or left out). Decisions compare each line with all lines of the input, removed ones
included, so they do not depend on any order of work.

Near lines are found by deletion neighbourhoods over words. Two lines within one edit share, without loss, the first or
the last (s - 1) div 2 words, s being the number of words of the shorter; forms of HALF_WORDS words or more emit variants
only if they share such a half with another form. Halves of shorter forms tell little, and those forms all emit variants. A variant is the form with a hole: at word i (deletion), or before word i (what a line with one word
more is without that word). Its hashed key covers the other words, the place of the hole and the length. Equal keys of
two deletions mean one word changed, of a deletion and an insertion one word more; for each key the earliest form of
either kind decides for all the others, so no pairs within a group are made. Each match is then verified word by word.
Words are hashed once, and in chunks, so that a key costs no more than the chunk and the number of chunks.

Defined cases: null text stays null and empty stays empty; lines that are no candidates stay; a row repeated exactly is one
document, returned as often as it came; a null doc_id comes last; other columns pass through; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import stored

MIN_WORDS = 5
#: More than nine of ten lines of MIN_WORDS words have on sf0.01; and the signs of about as many words.
MIN_CHARS = 40
MIN_SIGNS = 10
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
OTHER = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Anything but the blank that may be white space, and little else; most signs pass the first range or two.
SOME_OTHER = "[^ -~\xa1-\u167f\u3001-\uffff]"
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
LONG = f"^(?:(?:[^{WHITE}]++[{WHITE}]++){{{MIN_WORDS - 1}}}[^{WHITE}]|(?:[^{UNSPACED}]*+[{UNSPACED}]){{{MIN_SIGNS}}})"
HALF_WORDS = 12
CHUNK = 8


def trimmed(line: Column) -> Column:
    """Without white space at its ends. Few lines have any, and trimming by a list of signs costs several times as much as
    a look at both ends."""
    ends = F.substring(line, 1, 1).isin(*WHITE) | F.substring(line, -1, 1).isin(*WHITE)
    return F.when(ends, F.trim(line, F.lit(WHITE))).otherwise(line)


def form(line: Column) -> Column:
    return F.lower(trimmed(line))


def split_words(form: Column) -> Column:
    """Words between white space of any kind. Most forms hold single blanks only, which need no pattern; a test for the
    others takes a few ranges that hold all white space, as a class of many signs is slow on every other sign."""
    plain = F.when(form.contains("  "), F.split(form, " +")).otherwise(F.split(form, " "))
    return F.when(form.rlike(SOME_OTHER), F.split(form, f"[{OTHER}]+")).otherwise(plain)


def candidate(line: Column) -> Column:
    return (F.length(line) >= MIN_CHARS) | line.rlike(LONG)


def digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def row_key(id_col: str, text_col: str) -> Column:
    return digest(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("none")), F.coalesce(F.col(text_col), F.lit(""))))


def within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one word edit apart: a common head and tail cover all but one word."""

    def head(x: Column, y: Column) -> Column:
        same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
        return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.greatest(F.size(x), F.size(y)))

    longest = F.greatest(F.size(a), F.size(b))
    return head(a, b) + head(F.reverse(a), F.reverse(b)) >= longest - 1


def halves(words: Column) -> Column:
    """Keys of the last and first halves, in turns; two forms within one edit share at least one. An odd number of words
    makes another pair, for partners with one word less."""
    n = F.size(words)
    one, two = F.floor((n - 1) / 2).cast("int"), F.floor((n - 2) / 2).cast("int")
    tail = lambda m: F.xxhash64(F.lit(0), m, F.slice(words, n - m + 1, m))
    head = lambda m: F.xxhash64(F.lit(1), m, F.slice(words, F.lit(1), m))
    return F.array(tail(one), head(one), F.when(one != two, tail(two)), F.when(one != two, head(two)))


def chunks(hashes: Column, shift: int) -> Column:
    """Hash of each chunk of a line from the hashes of its words, as it is cut with so many words before it left out."""
    count = F.floor((F.size(hashes) - 1 + shift) / CHUNK).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda c: F.xxhash64(F.slice(hashes, F.greatest(c * CHUNK + 1 - shift, F.lit(1)), F.lit(CHUNK))))


def variants(dele: bool) -> Column:
    """Key and kind of every variant of one kind, of rows with the columns w (hashes of words), own and after (chunks),
    head and tail (whether that half is shared). Holes lie outside a half that is shared if the other is not."""
    n, more = F.size("w"), 0 if dele else 1
    half = F.floor((n - 2) / 2).cast("int")
    lo = F.when(F.col("head") & ~F.col("tail"), half).otherwise(0)
    hi = n - 1 + more - F.when(F.col("tail") & ~F.col("head"), half).otherwise(0)

    def one(i: Column) -> Column:
        c = F.floor(i / CHUNK).cast("int")
        a = c * CHUNK
        within = F.concat(F.slice("w", a + 1, i - a), F.slice("w", i + 2, a + CHUNK - 1 - i)) if dele else F.slice("w", a + 1, F.lit(CHUNK - 1))
        key = F.xxhash64(F.size("w") + more, i, F.slice("own", F.lit(1), c), within, F.slice("own" if dele else "after", c + 2, F.size("after")))
        return F.struct(key.alias("h"), F.lit(dele).alias("less"))

    return F.transform(F.sequence(lo, hi), one)


def first_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each form of a candidate: its key, its first place, whether near lines are sought for it without halves,
    and, where a partner may have more words, the keys of its halves."""
    lines = docs.select(F.col(id_col).alias("doc"), "_row", F.posexplode(F.split(text_col, "\n", -1)).alias("line", "raw")).withColumn("form", form(F.col("raw")))
    lines = lines.filter(candidate(F.col("form"))).withColumn("words", split_words(F.col("form")))
    place = F.struct(F.col("doc").isNull().alias("last"), F.col("doc"), F.col("_row"), F.col("line"))
    lines = lines.select(digest(F.col("form")).alias("key"), place.alias("place"), F.size("words").between(MIN_WORDS, HALF_WORDS - 1).alias("short"), F.when(F.size("words") >= HALF_WORDS - 1, halves(F.col("words"))).alias("halves"))
    return lines.groupBy("key").agg(F.min("place").alias("place"), F.first("short").alias("short"), F.first("halves").alias("halves"))


def near_forms(docs: DataFrame, forms: DataFrame, text_col: str) -> DataFrame:
    """Keys of the forms that an earlier form within one word edit makes redundant."""
    posts = forms.filter(F.col("halves").isNotNull()).select("key", F.posexplode("halves").alias("side", "k")).filter("k is not null")
    shared = posts.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    some = posts.join(shared.hint("merge"), "k", "left_semi").groupBy("key").agg(F.max(F.col("side") % 2 == 1).alias("head"), F.max(F.col("side") % 2 == 0).alias("tail"))
    some = forms.select("key", "place", "short").join(some.hint("merge"), "key", "left").filter("short or head is not null")
    some = some.select("key", "place", *((F.col("short") | F.coalesce(c, F.lit(False))).alias(c) for c in ("head", "tail")))
    # Ids ascend with the places, so that the earliest form has the smallest id.
    some = stored(some.orderBy("place").withColumn("id", F.monotonically_increasing_id()), "near-lines")
    wanted = some.groupBy(F.col("place._row").alias("_row")).agg(F.collect_list(F.struct(F.col("place.line").alias("line"), "id", "head", "tail")).alias("marked"))
    texts = docs.select("_row", text_col).join(wanted.hint("merge"), "_row").select(F.split(text_col, "\n", -1).alias("lines"), F.explode("marked").alias("m"))
    texts = texts.select("m.id", "m.head", "m.tail", split_words(form(F.element_at("lines", F.col("m.line") + 1))).alias("words"))
    texts = texts.groupBy("id").agg(F.first("head").alias("head"), F.first("tail").alias("tail"), F.first("words").alias("words"))
    texts = texts.withColumn("w", F.transform("words", lambda w: F.xxhash64(w)))
    # Written, so that the chunks are made once a line and not once a variant.
    texts = stored(texts.withColumn("own", chunks(F.col("w"), 0)).withColumn("after", chunks(F.col("w"), 1)), "near-texts")
    made = [texts.select("id", F.explode(variants(dele)).alias("v")).select("id", "v.h", "v.less") for dele in (True, False)]
    made = stored(made[0].unionByName(made[1]), "near-variants")
    texts = texts.select("id", "words")
    first = made.groupBy("h").agg(F.min(F.when(F.col("less"), F.col("id"))).alias("less_id"), F.min(F.when(~F.col("less"), F.col("id"))).alias("more_id"), F.count("*").alias("n"))
    first = first.filter("n > 1 and less_id is not null").drop("n")
    met = made.join(first.hint("merge"), "h").withColumn("other", F.when(F.col("less"), F.least("less_id", "more_id")).otherwise(F.col("less_id")))
    pairs = met.filter("other < id").select("id", "other").distinct()
    theirs = texts.select(F.col("id").alias("other"), F.col("words").alias("theirs"))
    checked = pairs.join(texts.hint("merge"), "id").join(theirs.hint("merge"), "other")
    gone = checked.filter(within_one(F.col("words"), F.col("theirs"))).select("id").distinct()
    return some.join(gone, "id", "left_semi").select("key")


def marks(kept: Column, n: Column) -> Column:
    """A sign for each of n lines, 1 if its number is among those kept (in order); linear in the lines."""
    before = lambda i: F.coalesce(F.get(kept, i - 1), F.lit(-1))
    ones = F.array_join(F.transform(kept, lambda x, i: F.concat(F.repeat(F.lit("0"), x - before(i) - 1), F.lit("1"))), "")
    return F.split(F.rpad(F.coalesce(ones, F.lit("")), n, "0"), "")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: bool = True) -> DataFrame:
    """All rows and columns of docs, text without its redundant lines, and _lines, _removed (counts; columns of docs with
    these two names are replaced)."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), rest.alias("rest"), row_key(id_col, text_col).alias("_row"))
    slim = keyed.select("id", "text", "_row")
    forms = first_lines(slim, "id", "text")
    if near:
        forms = stored(forms, "forms")
        forms = forms.join(near_forms(slim, forms, "text"), "key", "left_anti")
    kept = forms.groupBy(F.col("place._row").alias("_their_row")).agg(F.sort_array(F.collect_set("place.line")).alias("_kept"))
    out = keyed.join(kept, F.col("_row") == F.col("_their_row"), "left").withColumn("_all", F.split("text", "\n", -1)).withColumn("_marks", marks(F.col("_kept"), F.size("_all")))
    first = F.zip_with("_all", "_marks", lambda x, m: F.when((m == "1") | ~candidate(trimmed(x)), x))
    out = out.withColumn("_stays", F.array_compact(first))
    left = F.array_join("_stays", "\n")
    n, m = (F.when(F.col("text").isNull(), 0).otherwise(F.size(c).cast("long")) for c in ("_all", "_stays"))
    own = {id_col: F.col("id"), text_col: left}
    return out.select(*(own.get(c, F.col("rest")[c]).alias(c) for c in docs.columns if c not in ("_lines", "_removed")), n.alias("_lines"), (n - m).alias("_removed"))
