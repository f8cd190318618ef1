"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

A line goes if an equal line, or one within ``TAU`` edits (insertions, deletions, substitutions of code points), stands earlier in the
order of (id, hash of the whole text, line number). Equal lines meet by hash; similar ones by the pigeonhole principle: a line cut into TAU + 1 segments
keeps one of them whole under TAU edits. So each distinct line is indexed by its segments and probes, for each length that TAU edits allow, the
substrings that the multi-match-aware bounds leave (for TAU = 2: 12 in place of all). Keys hold length, segment number and substring, so only
lines of compatible lengths meet. Candidates are verified by a bit-parallel edit distance whose band of 2 TAU + 1 diagonals fits a long.

Distinct lines are gathered once with a map-side combine, so a line that holds a third of all rows leaves each partition once; on the way back
to its occurrences it is a skewed side of a join, which AQE splits. Signatures carry hashes only. Lines are told apart by 64 bits and checked by 64
more: of two lines that agree in the first and not in the second, the later is left alone.

Only lines of ``MIN_CHARS`` characters or more are compared for similarity; of shorter ones equal copies go. A document that is proved a copy of one other
is left alone, for document-level deduplication to judge; however much of any other document is repeated, its repeated lines go. What counts as proof is
lines whose equals stand first in one other document, and stay there: either these are all lines of the document in the other's order, and the other has no
more words than they, or the windows of ``SHINGLE`` words inside runs of them, taken in the order of both, are ``ALIKE`` of the windows of both documents together, which is what
near-dedup asks for. A part of a longer document, a copy of one that loses lines itself, lines in another order, passages of several documents, boilerplate beside lines of its own, and similar but unequal lines prove nothing.

Defined results: null and empty texts have no lines that count; lines of spaces only are never dropped; a null id counts as the smallest; rows
that share an id (or have none) but not the text are documents of their own; rows that repeat an id and a text share their fate and are counted as one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, whole_text

TAU = 2
MIN_CHARS = 20
#: Share of windows, and words in a window, at which near-dedup takes two documents for one.
ALIKE = 0.8
SHINGLE = 5
NO_ID = -(1 << 63)
#: Lines under one segment key from which on pairs are joined with the bound on their characters.
HOT = 8
#: Segment keys have 40 bits: most rows that are shuffled are a key of a line and a segment key. Whatever meets by chance is told apart by the distance.
SEGMENT_BITS = (1 << 40) - 1


def n_words(line: Column) -> Column:
    """How many words spaces separate in a line."""
    return F.size(F.array_remove(F.split(line, " "), ""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """(id, doc) of a row: ids can be null or repeated, so a hash of the whole text tells their rows apart."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.lit("doc"), whole_text(text_col)).alias("doc")]


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc, words, at, line, top) of every line with more than spaces; words: how many the document has, top: whether it is the document's first such line."""
    text = whole_text(text_col)
    # what is said of the whole text is settled first: beside posexplode it would be worked out again for every line
    before = F.substring(text, F.lit(1), F.char_length(text) - F.char_length(F.ltrim(text, F.lit(" \n"))))
    first_at = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit("")))
    rows = docs.select(*row_key(id_col, text_col), n_words(F.replace(text, F.lit("\n"), F.lit(" "))).alias("words"), first_at.alias("first_at"), F.split(text, "\n", -1).alias("lines"))
    each = rows.select("id", "doc", "words", "first_at", F.posexplode("lines").alias("at", "line"))
    return each.where(F.trim(F.col("line")) != "").select("id", "doc", "words", "at", "line", (F.col("at") == F.col("first_at")).alias("top"))


def line_key(line: Column) -> Column:
    return F.xxhash64(line)


def line_check(line: Column) -> Column:
    return F.xxhash64(F.lit("check"), line)


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One row per distinct line: key, and ``first``: the struct (id, doc, at, words, line) of its first occurrence.

    All that is needed later is in one aggregate, so that every use of this table shares one exchange.
    """
    return lines.select(line_key(F.col("line")).alias("key"), F.struct("id", "doc", "at", "words", "line").alias("row")).groupBy("key").agg(F.min("row").alias("first"))


def _segment(delta: int, i: int, tau: int) -> tuple[str, str]:
    """SQL for the start (from 1) and the size of segment i (from 1) of a line of m<delta> characters (see sized): sizes differ by one, the long ones last."""
    start = f"1 + {i - 1} * d{delta}" + (f" + greatest(0, r{delta} - {tau + 2 - i})" if i > 2 else "")
    return start, f"d{delta} + IF(r{delta} > {tau + 1 - i}, 1, 0)" if i > 1 else f"d{delta}"


def sized(lines: DataFrame, tau: int) -> DataFrame:
    """With the lengths m0 to m<tau> that a line's partners may have, and their quotients and remainders by tau + 1: short columns keep the code of keys compiled."""
    return lines.select("*", *(F.expr(f"{e} AS {name}{d}") for d in range(tau + 1) for name, e in (("m", f"n - {d}"), ("d", f"cast((n - {d}) div {tau + 1} as int)"), ("r", f"(n - {d}) % {tau + 1}"))))


def segment_keys(tau: int = TAU) -> list[Column]:
    """Index keys of column ``line`` of sized lines."""
    cut = [(i, *_segment(0, i, tau)) for i in range(1, tau + 2)]
    return [F.expr(f"xxhash64(m0, {i}, substring(line, {start}, {size})) & {SEGMENT_BITS}") for i, start, size in cut]


def probe_keys(tau: int = TAU, shortest: int = 0) -> list[Column]:
    """Keys under which lines of length n - tau to n may be indexed that are within tau edits, of sized lines of ``shortest`` characters or more; null where a length is too short."""
    out = []
    for delta in range(tau + 1):
        for i in range(1, tau + 2):
            start, size = _segment(delta, i, tau)
            for shift in range(max(-(i - 1), delta - (tau + 1 - i)), min(i - 1, delta + (tau + 1 - i)) + 1):
                key = f"xxhash64(m{delta}, {i}, substring(line, {start} + {shift}, {size})) & {SEGMENT_BITS}"
                out.append(F.expr(key if shortest - delta > tau else f"IF(m{delta} > {tau}, {key}, NULL)"))
    return out


def parity(line: Column) -> Column:
    """A bit for each class of characters: whether their number is odd. An edit changes two bits at most."""
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))


def banded_distance(a: Column, b: Column, tau: int = TAU) -> Column:
    """Edit distance of two strings whose lengths differ by at most tau, exact where it is at most tau (else larger); bit-parallel along the band.

    Common ends are cut off but for tau + 1 characters, without which the band would not fit. Bit k of a word stands for row
    j + tau - (width - 1) + k of column j; the differences of neighbouring cells are kept in two words, and the distance is followed along the lowest
    diagonal of the band and then along the last row. Once no cell of the band can be within tau, the remaining columns are passed over.
    """
    width = 2 * tau + 2
    ones, top, lost = (1 << width) - 1, width - 1, 3 * tau + 2
    long = lambda x: F.lit(x).cast("long")
    word = lambda x: x.bitwiseAND(long(ones))
    flip = lambda x: word(F.bitwise_not(x))

    def alike(p: Column, q: Column) -> Column:
        differs = F.array_position(F.zip_with(p, q, lambda x, y: x == y), F.lit(False))
        return F.when(differs == 0, F.least(F.size(p), F.size(q)).cast("long")).otherwise(differs - 1)

    def ends(s: Column) -> Column:
        short = F.least(F.size(s["p"]), F.size(s["q"])).cast("long")
        head = F.greatest(alike(s["p"], s["q"]) - (tau + 1), F.lit(0).cast("long"))
        tail = F.greatest(F.least(alike(F.reverse(s["p"]), F.reverse(s["q"])), short - head - (tau + 1)), F.lit(0).cast("long"))
        return F.struct(s["p"].alias("p"), s["q"].alias("q"), head.cast("int").alias("head"), (head + tail).cast("int").alias("cut"))

    def inner(s: Column) -> Column:
        part = lambda v: F.slice(v, s["head"] + 1, F.size(v) - s["cut"])
        return F.struct(part(s["p"]).alias("rows"), part(s["q"]).alias("columns"), (F.size(s["p"]) - s["cut"]).alias("m"))

    def run(s: Column) -> Column:
        start = F.struct(long(ones & (ones << (width - tau - 1))).alias("vp"), long(0).alias("vn"), long(tau).alias("d"), F.lit(0).alias("j"))

        def step(state: Column, c: Column) -> Column:
            j = state["j"] + 1
            match = long(0)
            for k in range(width):
                match = match + F.when(F.get(s["rows"], j + (tau - width + k)) == c, long(1 << k)).otherwise(long(0))
            bound = F.struct(match.alias("x"), state["vp"].alias("vp"), state["vn"].alias("vn"), state["d"].alias("d"), j.alias("j"))
            return F.when(state["d"] >= lost, state).otherwise(_let(bound, lambda t: _advance(t, s["m"], tau, top, word, flip)))

        return F.aggregate(s["columns"], start, step, lambda state: state["d"].cast("int"))

    pair = F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("q"))
    return _let(pair, lambda s: _let(ends(s), lambda t: _let(inner(t), run)))


def _let(value: Column, body) -> Column:
    """Evaluate a value once for several uses."""
    return F.get(F.transform(F.array(value), body), 0)


def _advance(s: Column, m: Column, tau: int, top: int, word, flip) -> Column:
    """The state after a column, from the state before and the column's matches x."""
    d0 = word(s["x"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(s["x"]).bitwiseOR(s["vn"])

    def settle(t: Column) -> Column:
        hp = t["vn"].bitwiseOR(flip(t["d0"].bitwiseOR(t["vp"])))
        hn = t["d0"].bitwiseAND(t["vp"])
        down = F.shiftrightunsigned(t["d0"], 1)
        one = F.lit(1).cast("long")
        diagonal = one - F.shiftrightunsigned(t["d0"], top)
        bit = F.call_function("shiftleft", one, F.greatest(F.lit(top) - (t["j"] - (m - tau)), F.lit(0)))
        along = F.when(hp.bitwiseAND(bit) != 0, one).when(hn.bitwiseAND(bit) != 0, -one).otherwise(F.lit(0).cast("long"))
        return F.struct(
            hn.bitwiseOR(flip(down.bitwiseOR(hp))).alias("vp"),
            down.bitwiseAND(hp).alias("vn"),
            (t["d"] + F.when(t["j"] <= m - tau, diagonal).otherwise(along)).alias("d"),
            t["j"].alias("j"),
        )

    return _let(F.struct(d0.alias("d0"), s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), s["j"].alias("j")), settle)


def candidates(lines: DataFrame, tau: int, min_chars: int) -> DataFrame:
    """Pairs (p, q) of keys of lines that share a segment; lines: (key, line, n).

    A segment held by more than ``HOT`` lines is met once by each line that probes it; its pairs are then joined under the condition that the parities of
    their characters allow tau edits, so that lines that share a segment and differ in words elsewhere are never emitted as pairs. The bound is exact.
    """
    own = F.array(*segment_keys(tau))
    index = sized(lines, tau).select("key", F.explode(own).alias("sig"))
    keys = F.when(F.col("n") >= min_chars, F.array(*probe_keys(tau, min_chars))).otherwise(own)
    probe = sized(lines, tau).select(F.col("key").alias("other"), F.explode(keys).alias("sig")).where("sig IS NOT NULL")
    group = Window.partitionBy("sig")
    counted = index.select("sig", "key", F.count(F.lit(1)).over(group).alias("held"), F.min("key").over(group).alias("least"))
    hot = F.col("held") > HOT
    met = counted.where(f"held <= {HOT} OR key = least").join(probe, "sig").where(f"held > {HOT} OR key <> other")
    met = met.select(F.when(hot, F.col("sig")).otherwise(F.least("key", "other")).alias("x"), F.when(hot, F.col("other")).otherwise(F.greatest("key", "other")).alias("y"), hot.alias("hot"))
    # hot is asked for as an aggregate: no filter gets below it, so its two uses share one exchange
    met = met.groupBy("x", "y", "hot").agg(F.max("hot").alias("is_hot"))
    cold = met.where("NOT is_hot").select(F.col("x").alias("p"), F.col("y").alias("q"))
    probing = met.where("is_hot").select(F.col("x").alias("sig"), F.col("y").alias("key"))
    known = sized(probing.join(lines, "key"), tau).select("sig", "key", F.array_contains(own, F.col("sig")).alias("holds"), F.coalesce(parity(F.col("line")), F.lit(0).cast("long")).alias("bits"))
    a, b = (known.select(*(F.col(c).alias(f"{side}_{c}") for c in known.columns)) for side in "ab")
    near = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= 2 * tau
    met_again = a.join(b, (F.col("a_sig") == F.col("b_sig")) & (F.col("a_key") < F.col("b_key")) & near & (F.col("a_holds") | F.col("b_holds")))
    return cold.unionByName(met_again.select(F.col("a_key").alias("p"), F.col("b_key").alias("q"))).groupBy("p", "q").agg(F.count(F.lit(1)).alias("_n")).select("p", "q")


def near_links(distinct: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """Links (a, b, distance) between keys of different lines within tau edits, a being the earlier line."""
    lines = distinct.select("key", F.col("first.line").alias("line"), F.char_length("first.line").alias("n")).where(F.col("n") >= max(min_chars - tau, tau + 1))
    ends = candidates(lines, tau, min_chars).select(F.explode(F.array("p", "q")).alias("key"), "p", "q")
    # both lines of a pair are fetched by one join and meet in its group of two
    fetched = ends.join(distinct, "key").groupBy("p", "q").agg(F.min("first").alias("f"), F.max("first").alias("g"), F.max(F.when(F.col("key") == F.col("p"), F.col("first"))).alias("of_p"))
    both = fetched.select(F.when(F.col("f") == F.col("of_p"), F.col("p")).otherwise(F.col("q")).alias("a"), F.when(F.col("f") == F.col("of_p"), F.col("q")).otherwise(F.col("p")).alias("b"), F.col("f.line").alias("f"), F.col("g.line").alias("g"))
    swap = F.char_length("f") < F.char_length("g")
    checked = both.select("a", "b", F.when(swap, F.col("g")).otherwise(F.col("f")).alias("long"), F.when(swap, F.col("f")).otherwise(F.col("g")).alias("short"))
    fit = checked.where((F.char_length("long") - F.char_length("short") <= tau) & (F.char_length("long") >= min_chars))
    fit = fit.where(F.bit_count(parity(F.col("long")).bitwiseXOR(parity(F.col("short")))) <= 2 * tau)
    return fit.withColumn("distance", banded_distance(F.col("long"), F.col("short"), tau)).where(F.col("distance") <= tau).select("a", "b", "distance")


def line_verdicts(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc, at, n, copy, near, links) of every line that counts: whether it equals, or is similar to, an earlier line, and how many lines it is similar to.

    Beside these, for the proof of copies: line_words, top (see occurrences), and ``first``, the struct (id, doc, words, at) of the first equal line and its document.
    """
    lines = occurrences(docs, id_col, text_col)
    distinct = distinct_lines(lines)
    pairs = near_links(distinct, tau, min_chars)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.lit(0).alias("later")), F.struct(F.col("b").alias("key"), F.lit(1).alias("later")))).alias("s")).select("s.*")
    linked = sides.groupBy("key").agg(F.count(F.lit(1)).alias("links"), F.max("later").alias("later"))
    known = distinct.join(linked, "key", "left").select("key", F.struct("first.id", "first.doc", "first.words", "first.at").alias("first"), line_check(F.col("first.line")).alias("first_check"), "links", "later")
    rows = lines.select("id", "doc", "at", n_words(F.col("line")).alias("line_words"), "top", F.char_length("line").alias("n"), line_key(F.col("line")).alias("key"), line_check(F.col("line")).alias("check"))
    same = F.col("check") == F.col("first_check")
    return rows.join(known, "key").select(
        "id", "doc", "at", "n",
        (same & ((F.col("id") != F.col("first.id")) | (F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))).alias("copy"),
        (same & (F.coalesce("later", F.lit(0)) == 1)).alias("near"),
        F.when(same, F.coalesce("links", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("links"),
        "line_words", "top", "first",
    )


def proved_copy(held: Column, n_lines: Column, words: Column, alike: float = ALIKE) -> Column:
    """Whether one other document has all lines in that order and no more words, or ``alike`` of the windows of both; held: sorted structs
    (id, doc, words, at_other, at, line_words) of lines that stand first in the document (id, doc)."""
    windows = lambda n: F.greatest(n - (SHINGLE - 1), F.lit(0))
    start = F.struct(
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("doc"), F.lit(0).alias("words"), F.lit(-2).alias("at_other"), F.lit(-2).alias("at"),
        F.lit(0).alias("run"), F.lit(0).alias("kept"), F.lit(0).cast("long").alias("lines"), F.lit(True).alias("ordered"), F.lit(False).alias("proved"),
    )

    def proved(s: Column) -> Column:
        kept = s["kept"] + windows(s["run"])
        both = F.greatest(windows(words), F.lit(1)) + F.greatest(windows(s["words"]), F.lit(1)) - kept
        whole = (s["lines"] == n_lines) & s["ordered"] & (s["words"] == words)
        return s["proved"] | whole | ((kept > 0) & (kept >= alike * both))

    def step(s: Column, x: Column) -> Column:
        same = s["id"].eqNullSafe(x["id"]) & s["doc"].eqNullSafe(x["doc"])
        later = (x["at"] > s["at"]) & (x["at_other"] > s["at_other"])
        follows = (x["at"] == s["at"] + 1) & (x["at_other"] == s["at_other"] + 1)
        of = lambda anew, joined, cut, passed: F.when(~same, anew).when(follows, joined).when(later, cut).otherwise(passed)
        return F.struct(
            x["id"].alias("id"), x["doc"].alias("doc"), x["words"].alias("words"),
            of(x["at_other"], x["at_other"], x["at_other"], s["at_other"]).alias("at_other"), of(x["at"], x["at"], x["at"], s["at"]).alias("at"),
            of(x["line_words"], s["run"] + x["line_words"], x["line_words"], s["run"]).alias("run"),
            of(F.lit(0), s["kept"], s["kept"] + windows(s["run"]), s["kept"]).alias("kept"),
            (F.when(same, s["lines"]).otherwise(F.lit(0).cast("long")) + 1).alias("lines"),
            F.when(same, s["ordered"] & later).otherwise(F.lit(True)).alias("ordered"),
            F.when(same, s["proved"]).otherwise(proved(s)).alias("proved"),
        )

    return F.when(F.size(held) > 0, F.aggregate(held, start, step, proved)).otherwise(F.lit(False))


def document_verdicts(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, alike: float = ALIKE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per id and text (see row_key) with lines: n_lines, n_copies, n_near, n_links, whole_copy, and the numbers (from 0) of the lines that go."""
    verdicts = line_verdicts(docs, tau, min_chars, id_col, text_col)
    goes = F.col("copy") | F.col("near")
    elsewhere = F.col("copy") & ~F.col("near") & ((F.col("id") != F.col("first.id")) | (F.col("doc") != F.col("first.doc")))
    at_first = F.struct("first.id", "first.doc", "first.words", F.col("first.at").alias("at_other"), "at", "line_words")
    long = lambda c: c.cast("long")
    found = verdicts.groupBy("id", "doc").agg(
        F.sum(long(F.col("top"))).alias("_rows"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(long(F.col("copy"))).alias("n_copies"),
        F.sum(long(F.col("near") & ~F.col("copy"))).alias("n_near"),
        F.sum("links").alias("n_links"),
        F.sum("line_words").alias("_words"),
        F.array_sort(F.collect_set(F.when(elsewhere, at_first))).alias("_held"),
        F.array_sort(F.collect_set(F.when(goes, F.col("at")))).alias("gone"),
    )
    # rows that repeat id and text are one document
    found = found.withColumns({c: F.expr(f"{c} div _rows") for c in ("n_lines", "n_copies", "n_near", "n_links", "_words")})
    found = found.withColumn("whole_copy", proved_copy(F.col("_held"), F.col("n_lines"), F.col("_words"), alike)).drop("_held", "_words", "_rows")
    return found.withColumn("gone", F.when(F.col("whole_copy"), F.array().cast("array<int>")).otherwise(F.col("gone")))


def line_dedup(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, alike: float = ALIKE) -> DataFrame:
    """One row per document: doc_id, n_lines, n_copies, n_near, n_links, whole_copy, n_dropped and dropped, the numbers of the lines that go."""
    found = document_verdicts(docs, tau, min_chars, alike)
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    ids = docs.select("doc_id", *row_key())
    gone = F.coalesce("gone", F.array().cast("array<int>"))
    return ids.join(found, ["id", "doc"], "left").select(
        "doc_id", zero("n_lines"), zero("n_copies"), zero("n_near"), zero("n_links"), F.coalesce("whole_copy", F.lit(False)).alias("whole_copy"), F.size(gone).cast("long").alias("n_dropped"),
        F.array_join(gone.cast("array<string>"), ",").alias("dropped"),
    )


def without_repeated_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, alike: float = ALIKE) -> DataFrame:
    """The documents, with all their columns, whatever their names, less the lines that go; n_chars follows the text."""
    line_id, line_doc, gone_col, of_id, of_doc = free_names(docs, "_line_id", "_line_doc", "_gone", "_own_id", "_own_doc")
    found = document_verdicts(docs, tau, min_chars, alike).where(F.size("gone") > 0).select(F.col("id").alias(line_id), F.col("doc").alias(line_doc), F.col("gone").alias(gone_col))
    own_id, own_doc = row_key()
    joined = docs.select("*", own_id.alias(of_id), own_doc.alias(of_doc)).join(found, (F.col(of_id) == F.col(line_id)) & (F.col(of_doc) == F.col(line_doc)), "left")
    gone = F.col(gone_col)
    rest = F.array_join(F.filter(F.split(F.col("text"), "\n", -1), lambda _, i: ~F.array_contains(gone, i)), "\n")
    text = F.when(gone.isNull(), F.col("text")).otherwise(rest)
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(gone.isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
