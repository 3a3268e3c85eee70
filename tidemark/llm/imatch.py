"""I-Match fingerprints with randomised lexicon subsets.

The lexicon holds the terms whose document frequency lies in a band: too common terms say
nothing, too rare ones are mostly noise. A fingerprint sorts a text's distinct lexicon
terms and hashes them, once with the whole lexicon and once with each of several random
parts of it. An edit changes the hash of a part only if it touches a term of that part,
so small parts survive edits that the whole does not; parts of several sizes serve texts
of all lengths. A last part hashes all terms of the text, so that only equal sets of terms
have equal fingerprints. The likeness of two fingerprints is the share of equal hashes among
the parts in which either text has a term.

Document frequencies count distinct texts, so the copies of a text do not push its terms
out of the band. A text without a term of the lexicon takes all of its own terms instead.

The band's lower edge is a share of the distinct texts, so the lexicon has at most
(mean distinct terms of a text) / (that share) terms, however many texts there are;
it is broadcast only if its counted size confirms that.

Everything is DataFrame operations. Terms are words between blanks, tabs and line breaks,
in lower case, and stand as 64-bit hashes.

Defined results: a null text counts as empty; a text without a word has a fingerprint of
empty parts, like only to another such; documents follow each other
by id (nulls first) and then by a hash of the text, the last is followed by the first; rows
of equal id and text are one document and get equal results; an empty table gives an empty
result; further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Shares of the distinct texts between which a lexicon term's document frequency lies.
RAREST, COMMONEST = 1 / 1000, 1 / 50
#: A term in fewer texts tells no two of them alike.
LEAST_DOCUMENTS = 2
#: Parts of the lexicon: so many random parts of the size 2^-level.
PARTS = {3: 3, 5: 5, 7: 8, 9: 8}
#: Terms up to which the lexicon is broadcast: 8 bytes each.
BROADCAST_TERMS = 2_000_000


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text): `row` names the id and text together."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.array_remove(F.split(F.lower(text), r"[ \t-\r]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def distinct_texts(rows: DataFrame) -> tuple[DataFrame, int]:
    """(text) of every distinct text once, and their number.

    Only texts that occur again are dealt out; a group of copies reaches its task as one row of each.
    """
    keyed = rows.select(F.xxhash64("text").alias("copy"), "text")
    keys = materialize(keyed.groupBy("copy").agg(F.count("*").alias("n")), "imatch-copies")
    again = materialize(keys.filter("n > 1").select("copy"), "imatch-again")
    single = keyed.join(again, "copy", "left_anti").select("text")
    once = keyed.join(again, "copy", "left_semi").groupBy("copy").agg(F.first("text").alias("text")).select("text")
    return single.unionByName(once), keys.count()


def lexicon(rows: DataFrame) -> DataFrame:
    """(term): the terms of the band."""
    texts, number = distinct_texts(rows)
    counted = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    low, high = max(LEAST_DOCUMENTS, RAREST * number), COMMONEST * number
    return counted.filter((F.col("df") >= low) & (F.col("df") <= max(high, low))).select("term")


def in_order(rows: DataFrame) -> DataFrame:
    """(row, doc_id, half, next_row): documents with half their length and the next document."""
    ordered = (
        rows.select("row", "doc_id", F.floor(F.length("text") / 2).cast("int").alias("half"))
        .distinct()
        .repartitionByRange("doc_id", "row")
        .sortWithinPartitions("doc_id", "row")
        .select("row", "doc_id", "half", F.monotonically_increasing_id().alias("place"))
    )
    ordered = materialize(ordered, "imatch-order")
    # One row per partition: how many documents lie before it.
    part = F.shiftrightunsigned("place", 33)
    sizes = sorted(ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    total, before = 0, []
    for number, n in sizes:
        before.append((number, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "part LONG, before LONG")
    local = F.col("place") - F.shiftleft(part, 33)
    numbered = ordered.withColumn("part", part).join(F.broadcast(offsets), "part")
    numbered = numbered.select("row", "doc_id", "half", (local + F.col("before")).alias("number"))
    following = numbered.select(
        F.pmod(F.col("number") - 1, F.lit(max(total, 1)).cast("long")).alias("number"), F.col("row").alias("next_row")
    )
    return numbered.join(following, "number").select("row", "doc_id", "half", "next_row")


def edited_texts(rows: DataFrame, order: DataFrame) -> DataFrame:
    """(row, text, edited) of each row once: the last half of its text replaced by the start of the next."""
    rows = rows.groupBy("row").agg(F.first("text").alias("text"))
    heads = rows.join(
        order.select(F.col("next_row").alias("row"), F.col("row").alias("owner"), "half"), "row"
    )
    heads = heads.select(F.col("owner").alias("row"), "half", F.substring("text", F.lit(1), F.col("half")).alias("head"))
    kept = F.substring("text", F.lit(1), F.length("text") - F.col("half"))
    return rows.join(heads, "row").select("row", "text", F.concat(kept, "head").alias("edited"))


def _hashed(own: Column) -> Column:
    return F.when(F.size(own) > 0, F.xxhash64(own))


def _parts(sorted_terms: Column, all_terms: Column) -> Column:
    """Hashes of a text's terms in the whole lexicon and in each part, then of all; null where it has none."""

    def drawn(seed: int, level: int):
        mask = F.lit((1 << level) - 1).cast("long")
        return lambda term: F.xxhash64(term, F.lit(100 * level + seed)).bitwiseAND(mask) == 0

    parts = [_hashed(sorted_terms)]
    parts += [_hashed(F.filter(sorted_terms, drawn(seed, level))) for level, count in PARTS.items() for seed in range(count)]
    return F.array(*parts, _hashed(all_terms))


def fingerprints(texts: DataFrame, lexicon_terms: DataFrame) -> DataFrame:
    """(row, parts, edited_parts, edited_sha256) of (row, text, edited).

    The texts are dealt by row, and so is what is grouped here: nothing moves again.
    """
    small = lexicon_terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    band = F.broadcast(lexicon_terms) if small else lexicon_terms
    both = F.array(
        F.struct(F.lit(False).alias("changed"), terms(F.col("text")).alias("terms")),
        F.struct(F.lit(True).alias("changed"), terms(F.col("edited")).alias("terms")),
    )
    split = texts.select("row", F.sha2("edited", 256).alias("edited_sha256"), F.inline(both))
    found = split.select("row", "edited_sha256", "changed", F.explode_outer("terms").alias("term"))
    # A left join keeps texts without any term of the lexicon.
    marked = found.join(band.withColumn("known", F.lit(True)), "term", "left")
    known, changed = F.col("known"), F.col("changed")

    def gathered(where: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(where, F.col("term"))))

    grouped = marked.groupBy("row").agg(
        F.first("edited_sha256").alias("edited_sha256"),
        gathered(~changed & known).alias("own_band"),
        gathered(changed & known).alias("other_band"),
        gathered(~changed).alias("own_all"),
        gathered(changed).alias("other_all"),
    )
    chosen = grouped.select(
        "row",
        "edited_sha256",
        "own_all",
        "other_all",
        *(F.when(F.size(f"{x}_band") > 0, F.col(f"{x}_band")).otherwise(F.col(f"{x}_all")).alias(x) for x in ("own", "other")),
    )
    return chosen.select(
        "row",
        _parts(F.col("own"), F.col("own_all")).alias("parts"),
        _parts(F.col("other"), F.col("other_all")).alias("edited_parts"),
        "edited_sha256",
    )


def shown(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.lower(F.hex(p)), F.lit("-"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the parts in which either text has a term; 1 if neither has a word."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNotNull() | y.isNotNull(), (x.eqNullSafe(y)).cast("int")))
    filled = F.array_compact(pairs)
    equal = F.aggregate(filled, F.lit(0), lambda total, x: total + x)
    return F.when(F.size(filled) > 0, equal / F.size(filled)).otherwise(F.lit(1.0))


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = text_rows(docs, id_col, text_col)
    order = materialize(in_order(rows), "imatch-next")
    terms_in_band = materialize(lexicon(rows), "imatch-lexicon")
    prints = fingerprints(edited_texts(rows, order), terms_in_band)
    prints = materialize(prints, "imatch-prints")
    following = prints.select(F.col("row").alias("next_row"), F.col("parts").alias("next_parts"))
    known = prints.join(order.select("row", "next_row"), "row").join(following, "next_row")
    answer = known.select(
        "row",
        "edited_sha256",
        shown(F.col("parts")).alias("fingerprint"),
        shown(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )
    each = rows.select("row", "doc_id", F.length("text").cast("long").alias("n_chars"))
    return each.join(answer, "row").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
