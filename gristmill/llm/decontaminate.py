"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is the words at a fixed mask's positions; the words between them are ignored, so a seed
survives substitutions there.  Seeds of benchmark items and of documents meet in a hash join; around
each hit, the words of both sides are compared position by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import cut

# Five positions each; chosen so that four substitutions anywhere in 20 words, or three in 15,
# leave one seed of one mask whole.
MASKS = ((0, 1, 2, 7, 8), (0, 2, 3, 4, 5), (0, 1, 3, 4, 8))
# Items of at most SHORT words also have seeds of three words: two substitutions in 10 words, or one in
# 5 to 9, leave one of these whole; items of 3 or 4 words allow none.
SHORT = 10
SHORT_MASKS = ((0, 1, 2), (0, 1, 3))
# Words that an overlap must span (an item that is shorter: all its words), and the share that must agree.
WINDOW = 20
AGREE = 0.8
# Size of the bit table of benchmark seeds, as a power of two; fixed, whatever the benchmark's size.
BITS = 22


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))


def _seeds(tokens: Column, at: Column, masks: Sequence[Sequence[int]]) -> list[Column]:
    """One hash per mask at word ``at``; null where the mask goes past the end."""
    return [
        F.when(at + mask[-1] < F.size(tokens), F.xxhash64(F.lit(m), *[F.get(tokens, at + k) for k in mask]))
        for m, mask in enumerate(masks)
    ]


def _probes(seed: Column) -> list[Column]:
    """The two bits of the table that a seed sets."""
    size = (1 << BITS) - 1
    return [seed.bitwiseAND(F.lit(size)), F.shiftrightunsigned(seed, 32).bitwiseAND(F.lit(size))]


def _bit_table(seeds: DataFrame) -> DataFrame:
    """One row: the bits that ``seeds`` set, as an array of longs of fixed length."""
    bits = seeds.select(F.explode(F.array(*_probes(F.col("seed")))).alias("bit"))
    filled = bits.groupBy(F.shiftright("bit", 6).alias("i")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))).alias("b")
    )
    slots = seeds.sparkSession.range(1 << (BITS - 6)).select(F.col("id").alias("i"))
    table = slots.join(filled, "i", "left").select("i", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    pairs = F.array_sort(F.collect_list(F.struct("i", "b")))
    return table.agg(F.transform(pairs, lambda x: x["b"]).alias("bits"))


def _positions(rows: DataFrame, masks: Sequence[Sequence[int]]) -> DataFrame:
    """Each row of (…, tokens) once per word at which some mask fits."""
    last = F.size("tokens") - min(mask[-1] for mask in masks) - 1
    return rows.withColumn("at", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))


def _around(tokens: Column, at: Column, reach: int, window: int) -> Column:
    """Up to ``window`` - 1 words before ``at`` and ``reach`` + ``window`` from it on, joined."""
    start = F.greatest(at - (window - 1), F.lit(0))
    return F.array_join(F.slice(tokens, start + 1, at - start + reach + window), " ")


def _once(rows: DataFrame, *keep: str, **made: Column) -> DataFrame:
    """``rows`` with the columns ``made``, computed once: the optimizer would copy their expressions
    into every place that uses them, lambdas included, but not through a generator."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("made")
    return rows.select(*keep, one).select(*keep, "made.*")


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    masks: Sequence[Sequence[int]] = MASKS,
    window: int = WINDOW,
    agree: float = AGREE,
    short_masks: Sequence[Sequence[int]] = SHORT_MASKS,
) -> DataFrame:
    """doc_id, item_id, n_equal, n_compared, first_word: the best overlap of each contaminated pair.

    A pair is contaminated if, aligned at a seed they share, some ``window`` successive words around
    it (an item of fewer words: the whole item) agree in at least ``agree`` of their places.
    ``first_word`` is the smallest word position of a document's hit with that best overlap.

    Document seeds are first looked up in a bit table of the benchmark's seeds (fixed size, 512 kB), so
    of the documents only probable hits are shuffled, each with the words around it.  A passage that
    many documents hold is a skewed key of that join, which the engine splits.

    Items of at most ``SHORT`` words are met by ``short_masks`` too, which are looked up in the documents
    only if there are such items.

    Null and empty texts have no words and no leaks, as have items shorter than the shortest mask;
    texts of any length are read whole; equal items each report; rows that repeat an id count as one
    document; null ids are kept as null; an empty table gives no rows; other columns are ignored.
    """
    tokens = items.select("item_id", words(F.col("text")).alias("tokens"))
    few = F.size("tokens") <= SHORT
    long_masks = len(masks)
    if not tokens.where(few & (F.size("tokens") > 0)).isEmpty():
        masks = [*masks, *short_masks]
    reach = max(mask[-1] for mask in masks) + 1
    made = _seeds(F.col("tokens"), F.col("at"), masks)
    made = [*made[:long_masks], *[F.when(few, seed) for seed in made[long_masks:]]]
    bench = _positions(tokens, masks)
    bench = bench.select(
        "item_id",
        F.size("tokens").alias("item_words"),
        F.col("at").alias("item_at"),
        F.explode(F.array(*made)).alias("seed"),
        _around(F.col("tokens"), F.col("at"), reach, window).alias("item_around"),
    ).where("seed is not null")
    bench = cut(bench)
    bits = cut(_bit_table(bench)).scalar()

    def known(seed: Column) -> Column:
        first, second = (
            F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1
            for p in _probes(seed)
        )
        return first & second

    placed = _positions(docs.select("doc_id", words(F.col("text")).alias("tokens")), masks)
    # one row per seed, so that the generated code tests one seed at a time and stays small
    seeds = F.explode(F.array(*_seeds(F.col("tokens"), F.col("at"), masks))).alias("seed")
    hits = placed.select("doc_id", "tokens", "at", seeds).where(known(F.col("seed")))
    hits = hits.select("doc_id", "at", "seed", _around(F.col("tokens"), F.col("at"), reach, window).alias("around"))
    joined = hits.join(bench, "seed")

    # align both sides at the seed, then count agreements in every window of the common stretch
    before = F.least("at", "item_at", F.lit(window - 1))
    mine, theirs = F.split("around", " "), F.split("item_around", " ")
    cut_mine = F.slice(mine, F.least("at", F.lit(window - 1)) - before + 1, F.size(mine))
    cut_theirs = F.slice(theirs, F.least("item_at", F.lit(window - 1)) - before + 1, F.size(theirs))
    length = F.least(F.size("mine"), F.size("theirs"))
    need = F.least(F.col("item_words"), F.lit(window))
    equal = F.transform(
        F.sequence(F.lit(0), F.col("length") - 1),
        lambda i: (F.get(F.col("mine"), i) == F.get(F.col("theirs"), i)).cast("int"),
    )
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(1), F.col("length") - F.col("need") + 1),
            lambda s: F.aggregate(F.slice("equal", s, F.col("need")), F.lit(0), lambda a, x: a + x),
        )
    )
    aligned = _once(joined, "doc_id", "item_id", "at", need=need, mine=cut_mine, theirs=cut_theirs)
    aligned = aligned.withColumn("length", length).where(F.col("length") >= F.col("need"))
    counted = _once(aligned, "doc_id", "item_id", "at", "need", "length", equal=equal)
    compared = _once(counted, "doc_id", "item_id", "at", "need", n_equal=best)
    compared = compared.where(F.col("n_equal") >= F.ceil(F.col("need") * agree))
    return compared.groupBy("doc_id", "item_id").agg(
        F.max("n_equal").alias("n_equal"),
        F.max("need").alias("n_compared"),
        (-F.max(F.struct("n_equal", -F.col("at")))["col2"]).alias("first_word"),
    )


def drop_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose id has a leak (a null id included); all columns stay."""
    leaks = find_leaks(docs, items, **options).select(F.col("doc_id").alias("leaky")).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("leaky")), "left_anti")


def leaks_sql(masks: Sequence[Sequence[int]] = MASKS, window: int = WINDOW, agree: float = AGREE) -> str:
    """The same pairs in SQL: seeds joined word by word, every window of every alignment tried."""
    shortest = min(mask[-1] for mask in masks)
    seeds = " union all ".join(
        "select {0} as k, id, pos, n, tokens, " .format(m)
        + " || ' ' || ".join(f"tokens[pos + {k + 1}]" for k in mask)
        + f" as seed from {{0}} where pos + {mask[-1]} < n"
        for m, mask in enumerate(masks)
    )
    return f"""
with d as (select doc_id as id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as tokens from documents),
b as (select item_id as id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as tokens from benchmark),
dp as (select id, len(tokens) as n, tokens, unnest(range(len(tokens) - {shortest})) as pos from d),
bp as (select id, len(tokens) as n, tokens, unnest(range(len(tokens) - {shortest})) as pos from b),
ds as ({seeds.format("dp")}), bs as ({seeds.format("bp")}),
h as (select distinct ds.id as doc_id, bs.id as item_id, ds.pos, bs.pos as item_pos, ds.tokens, bs.tokens as item_tokens,
  least(bs.n, {window}) as need, least(ds.pos, bs.pos, {window - 1}) as back,
  least(ds.n - ds.pos, bs.n - bs.pos, {max(m[-1] for m in masks) + 1 + window}) as ahead
  from ds join bs on ds.k = bs.k and ds.seed = bs.seed),
w as (select *, unnest(range(pos - back, pos + ahead - need + 1)) as start from h where back + ahead >= need),
p as (select *, unnest(range(need)) as j from w),
c as (select doc_id, item_id, pos, item_pos, start, any_value(need) as need,
  sum((tokens[start + j + 1] = item_tokens[item_pos + start - pos + j + 1])::int) as equal
  from p group by all),
c2 as (select doc_id, item_id, pos, need, equal from c where equal >= ceil(need * {agree}))
select doc_id, item_id, max(equal)::int as n_equal, max(need)::int as n_compared,
  min(pos) filter (where equal = top)::int as first_word
from (select *, max(equal) over (partition by doc_id, item_id) as top from c2) group by doc_id, item_id"""
