"""Normalise texts (F10, F11, F13, P1, P2, P5) as explode -> join -> regroup.

Plan shape, per call::

    texts --posexplode--> tokens (row_id, pos, word)             narrow
    texts --counts per Arrow batch, word--> raw words, cleaned     1 shuffle (partial agg), checkpoint
    cleaned words that could hit --distinct--> cascade            word map (hits only), checkpoint + count
    raw words JOIN word map --> per-raw-token answers              hits + skipped, checkpoint + count
    tokens LEFT JOIN answers on the raw word --> stage, out_word   broadcast
    changed tokens + position-0 token --groupBy(row_id)--> text   per-row list of replacements

Big text columns are never copied per token: they ride along on the token at
position 0 only and are picked up again by the regroup, which rebuilds each
text from its own token array and the sorted list of its replacements.

Beyond the broadcast gate only tokens that pass a Bloom filter over the answered
words meet the answers in a shuffle join by word (frequent words salted), as
(row_id, pos, word) without any text; the texts are joined with their rows'
replacements by row_id::

    tokens that may hit --word--> answers --> (row_id, pos, out_word)
    replacements --groupBy(row_id)--> JOIN texts by row_id --> text
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators.layout import spread_by
from wordloom.operators.match import VALUE_COLS, MatchParams, word_map
from wordloom.operators.wordcount import word_counts
from wordloom.operators.wordfilter import word_filter
from wordloom.session import cut_lineage
from wordloom.sources.dictionary import Dictionary

# Size gate for the token-side join: word maps up to this many rows are broadcast.
WORD_MAP_BROADCAST_ROWS = 1_000_000
# Salt buckets of hot words in the shuffle join used beyond the gate.
SALT_BUCKETS = 64
# A word is hot with more than this share (1 / HOT_SHARE) of all answered tokens: fewer than HOT_SHARE words are.
HOT_SHARE = 1000

# Token stages: "short" (< 2 characters, untouched), "skipped" (cleans to
# nothing, untouched), then the cascade's "exact" / "fuzzy" / "stretch", or "none".
HIT_STAGES = ("exact", "fuzzy", "stretch")
FORM_COLS = ("clean", "stage", "match_key", "ord", "value", "similarity", "out_word")


def tokenize(df: DataFrame, text_col: str = "text", keys: tuple[str, ...] = ("row_id",),
             carry: tuple[str, ...] = ()) -> DataFrame:
    """F4 + F1: one row per whitespace token with its position and cleaned form.

    ``keys`` are small columns copied to every token; ``carry`` columns are
    packed into a struct present on the token at position 0 only.  ``clean`` is
    null for tokens shorter than two characters (never looked up).
    """
    exploded = df.select(*keys, *carry, F.posexplode(tx.split_words(F.col(text_col))).alias("pos", "word"))
    cols: list[Column | str] = [*keys, "pos", "word"]
    if carry:
        cols.append(F.when(F.col("pos") == 0, F.struct(*carry)).alias("_carry"))
    return (
        exploded.filter(F.col("word") != "")
        .select(*cols)
        .withColumn("clean", F.when(F.length("word") >= 2, tx.clean_word(F.col("word"))))
    )


def vocabulary(tokens_df: DataFrame) -> DataFrame:
    """Distinct cleaned words that reach the lookup (the memo's key set).

    Distinct raw tokens first (partial aggregation), so the cleaning regex runs
    once per distinct token, not once per occurrence.
    """
    return lookup_words(raw_words(tokens_df))


def lookup_words(raw: DataFrame) -> DataFrame:
    """The distinct cleaned words of raw words (see :func:`raw_words`, :func:`text_words`) that reach the lookup."""
    return raw.filter(_bound("clean", lambda c: c != "")).select("clean").distinct()


def _bound(name: str, condition: Callable[[Column], Column]) -> Column:
    """``condition`` on a column that a filter would otherwise compute anew at every mention."""
    return F.coalesce(F.exists(F.array(name), condition), F.lit(False))


def raw_words(tokens_df: DataFrame) -> DataFrame:
    """Distinct raw tokens of two characters or more: word, n_tokens, clean.

    ``clean`` is bound to the count, so that no filter on it is pushed below the aggregate, where its
    regexes would run for every token.
    """
    raw = tokens_df.filter(F.length("word") >= 2).groupBy("word").agg(F.count(F.lit(1)).alias("n_tokens"))
    return _cleaned(raw)


def text_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """:func:`raw_words` of whole texts, without a row per token."""
    return _cleaned(word_counts(df, F.col(text_col), min_length=2).withColumnRenamed("n", "n_tokens"))


def _cleaned(raw: DataFrame) -> DataFrame:
    return raw.withColumn("clean", F.when(F.col("n_tokens") > 0, tx.clean_word(F.col("word"))))


@dataclass
class Normalizer:
    """F13 ``preprocess_dataset`` as DataFrame -> DataFrame transforms."""

    dictionary: Dictionary
    params: MatchParams = field(default_factory=MatchParams)
    broadcast_rows: int = WORD_MAP_BROADCAST_ROWS
    salt_buckets: int = SALT_BUCKETS
    strategy: str = "auto"  # fuzzy candidates: "bucket", "deletion" or "auto"
    cut: Callable[[DataFrame], DataFrame] = cut_lineage  # how intermediate tables are kept; a stream gives its own

    # -- word level -------------------------------------------------------
    def word_map(self, tokens_df: DataFrame) -> DataFrame:
        """J6 over the tokens' distinct cleaned words that could hit (hits only);
        tokens are made distinct before cleaning."""
        return self.raw_word_map(raw_words(tokens_df))

    def raw_word_map(self, raw: DataFrame) -> DataFrame:
        """J6 over the cleaned words of distinct raw words."""
        return word_map(self._candidates(raw), self.dictionary, self.params, self.strategy)

    def materialize(self, table: DataFrame) -> tuple[DataFrame, bool]:
        """Checkpoint a lookup table (lineage cut) and decide broadcast by its row count."""
        table = self.cut(table)
        return table, table.count() <= self.broadcast_rows

    def word_forms(self, tokens_df: DataFrame) -> DataFrame:
        """The answer for every distinct raw token that is a hit or cleans to nothing.

        A token's stage and output depend on the raw token alone, so the work is
        done once per distinct raw token (two characters or more): clean it,
        look the cleaned word up in the word map, and build the output form
        (case pattern, kept punctuation).  Columns: word, n_tokens, clean,
        stage, match_key, ord, value, similarity, out_word.  Tokens absent from
        it are "short" (under two characters) or "none", and stay as they are.
        """
        return self.answers(self.cut(raw_words(tokens_df)))

    def text_forms(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """:meth:`word_forms` of whole texts."""
        return self.answers(self.cut(text_words(df, text_col)))

    def answers(self, raw: DataFrame) -> DataFrame:
        """Answers for distinct raw words (word, n_tokens, clean): those that hit or clean to nothing."""
        wm, small = self.materialize(word_map(self._candidates(raw), self.dictionary, self.params, self.strategy))
        side = wm.select(F.col("clean").alias("_wclean"), "stage", "match_key", "ord", *VALUE_COLS, "similarity")
        joined = raw.join(F.broadcast(side) if small else side, F.col("clean") == F.col("_wclean"), "left")
        pattern = tx.case_pattern(F.col("word"))
        value = tx.apply_case(
            pattern, F.col("value"), F.col("value_upper"), F.col("value_title"), F.col("value_lower"),
            with_lower=F.col("stage") != "stretch",
        )
        return joined.filter(F.col("stage").isNotNull() | (F.col("clean") == "")).select(
            "word", "n_tokens", "clean",
            F.when(F.col("clean") == "", F.lit("skipped")).otherwise(F.col("stage")).alias("stage"),
            "match_key", "ord", "value", "similarity",
            F.when(F.col("stage").isNotNull(), tx.replace_core(F.col("word"), value))
            .otherwise(F.col("word")).alias("out_word"),
        )

    def _candidates(self, words: DataFrame) -> DataFrame:
        """Distinct cleaned words that could hit at all (lossless prune): exact and
        fuzzy hits need a length within ``k`` of some key's length, stretch hits a
        run of three equal characters; other words can only be "none"."""
        lo, hi = self.dictionary.key_lengths
        k = self.params.fuzzy_threshold

        def possible(c: Column) -> Column:
            return (c != "") & (F.length(c).between(max(lo - k, 0), hi + k) | c.rlike(tx.STRETCH_RUN))

        return words.filter(_bound("clean", possible)).select("clean").distinct()

    def annotate(self, tokens_df: DataFrame,
                 forms: DataFrame | tuple[DataFrame, bool] | None = None) -> DataFrame:
        """Attach stage and normalised word to every token.

        Tokens join the per-raw-token answers on the raw word (broadcast after a
        count), so no per-token regex runs here.  Beyond the bound only tokens
        that pass a Bloom filter over the answered words are shuffled.
        ``clean`` / ``match_key`` / ``value`` / ``similarity`` are set for hits
        (``clean`` also for skipped tokens) and null otherwise.  ``forms`` may
        be given: a DataFrame of :meth:`word_forms`, or the pair returned by
        :meth:`materialize` (then it is used as is).
        """
        forms, small = self._given(tokens_df, forms)
        t = tokens_df.drop("clean")
        token_cols = t.columns
        if small:
            joined = t.join(F.broadcast(_side(forms)), F.col("word") == F.col("_fword"), "left")
        else:
            marked = word_filter(forms, forms.count(), cut=self.cut).marked(t, name="_maybe")
            others = marked.where("not _maybe").drop("_maybe")
            others = others.select(*token_cols, *[F.lit(None).cast(f.dataType).alias(f.name) for f in _side(forms).schema])
            joined = self._meet(marked.where("_maybe").drop("_maybe"), forms, "left").unionByName(others)
        stage = F.when(F.length("word") < 2, F.lit("short")).otherwise(F.coalesce(F.col("_f_stage"), F.lit("none")))
        return joined.select(
            *token_cols,
            F.col("_f_clean").alias("clean"), stage.alias("stage"),
            *[F.col(f"_f_{c}").alias(c) for c in ("match_key", "ord", "value", "similarity")],
            F.coalesce(F.col("_f_out_word"), F.col("word")).alias("out_word"),
        )

    def _given(self, tokens_df: DataFrame, forms: DataFrame | tuple[DataFrame, bool] | None) -> tuple[DataFrame, bool]:
        if isinstance(forms, tuple):  # already materialised by the caller
            return forms
        return self.materialize(self.word_forms(tokens_df) if forms is None else forms)

    def _meet(self, toks: DataFrame, forms: DataFrame, how: str) -> DataFrame:
        """Shuffle join of tokens and answers by word; the tokens of hot words are dealt over salts, and only these words' answers repeated."""
        total = forms.agg(F.sum("n_tokens")).first()[0] or 0
        hot = F.col("n_tokens") * HOT_SHARE > F.lit(total)
        hot_words = F.broadcast(self.cut(forms.where(hot).select(F.col("word").alias("_hot"))))  # fewer than HOT_SHARE
        keys = [c for c in toks.columns if c not in ("word", "_carry")]
        n = F.lit(self.salt_buckets)
        salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*keys), n)).otherwise(F.lit(0).cast("bigint"))
        t = toks.join(hot_words, F.col("word") == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot")
        salts = F.when(hot, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array(F.lit(0).cast("bigint")))
        s = _side(forms.withColumn("_fsalt", F.explode(salts)), "_fsalt")
        return t.join(s, (F.col("word") == F.col("_fword")) & (F.col("_salt") == F.col("_fsalt")), how).drop("_salt", "_fsalt")

    # -- text level -------------------------------------------------------
    def normalize(self, df: DataFrame, text_col: str = "text", row_id: str = "row_id",
                  keep_original: bool = True, forms: DataFrame | tuple[DataFrame, bool] | None = None) -> DataFrame:
        """all columns kept, ``text_col`` normalised, ``<text>_original`` last,
        rows whose normalised text is blank removed (P1, F11, P2).  ``row_id`` must
        be unique among texts that are not blank; a repeated one raises.

        ``forms``: per-raw-token answers already computed for these texts
        (see :meth:`annotate`), to share them with other passes.
        """
        others = [c for c in df.columns if c != row_id]
        original = f"{text_col}_original" if keep_original else None
        df = spread_by(df, row_id)
        toks = tokenize(df, text_col, keys=(row_id,), carry=tuple(others))
        forms, small = self._given(toks, self.text_forms(df, text_col) if forms is None else forms)
        if small:
            return regroup(self.annotate(toks, (forms, True)), row_id, text_col, others, original_col=original,
                           may_turn_blank=self.dictionary.has_blank_values)
        return self._rejoined(df, text_col, row_id, forms, original)

    def blank_counts(self, df: DataFrame, by: str, text_col: str = "text", row_id: str = "row_id") -> DataFrame:
        """Rows in and out of the blank filter per group.

        A text is blank afterwards if it was blank before, unless a dictionary value is blank: then texts are normalised."""
        if self.dictionary.has_blank_values:
            kept = self.normalize(df.select(row_id, text_col), text_col, row_id, keep_original=False)
            df = df.select(row_id, by).join(kept, row_id, "left")
        return df.groupBy(by).agg(
            F.count(F.lit(1)).cast("long").alias("rows_in"), F.count_if(~tx.is_blank(F.col(text_col))).cast("long").alias("rows_out"))

    def _rejoined(self, df: DataFrame, text_col: str, row_id: str, forms: DataFrame, original: str | None) -> DataFrame:
        """F13 beyond the gate: only words that may change are shuffled by word, texts meet their changes by row id."""
        hit_forms = forms.where(F.col("stage").isin(*HIT_STAGES))
        toks = tokenize(df, text_col, keys=(row_id,)).drop("clean")
        probable = word_filter(hit_forms, hit_forms.count(), cut=self.cut).keep(toks)
        hits = self._meet(probable, hit_forms, "inner").select(row_id, F.struct("pos", F.col("_f_out_word").alias("out_word")).alias("_hit"))
        texts = df.where(~tx.is_blank(F.col(text_col)))
        marks = texts.select(row_id, F.lit(None).cast(hits.schema["_hit"].dataType).alias("_hit"))
        g = hits.unionByName(marks).groupBy(row_id).agg(F.collect_list("_hit").alias("_hits"), F.count_if(F.col("_hit").isNull()).alias("_rows"))
        g = g.select(F.col(row_id).alias("_id"), _once(row_id, F.col("_id"), F.col("_hits")).alias("_hits"))
        same = F.col(row_id).eqNullSafe(F.col("_id")) if df.schema[row_id].nullable else F.col(row_id) == F.col("_id")
        out = texts.join(g, same).withColumn("_text", _rebuilt(F.col(text_col), F.col("_hits")))
        out = out.filter(~tx.is_blank(F.col("_text"))) if self.dictionary.has_blank_values else out
        cols = [F.col("_text").alias(text_col) if c == text_col else F.col(c) for c in [row_id, *(c for c in df.columns if c != row_id)]]
        return out.select(*cols, *([F.col(text_col).alias(original)] if original else []))


def _side(forms: DataFrame, *more: str) -> DataFrame:
    return forms.select(F.col("word").alias("_fword"), *more, *[F.col(c).alias(f"_f_{c}") for c in FORM_COLS])


def _once(name: str, row_id: Column, hits: Column) -> Column:
    """``hits``; two texts under one id would be merged: stop instead."""
    repeated = F.raise_error(F.concat(F.lit(f"repeated {name}: "), F.to_json(F.struct(row_id.alias(name)))))
    return F.when(F.col("_rows") > 1, repeated.cast("array<struct<pos: int, out_word: string>>")).otherwise(hits)


def _rebuilt(text: Column, hits: Column) -> Column:
    """The text with its changed words; without a change only the whitespace is collapsed."""
    return tx.rebuilt(text, hits)


def regroup(annotated: DataFrame, row_id: str, text_col: str, order: list[str],
            keys: tuple[str, ...] = (), original_col: str | None = None, may_turn_blank: bool = True) -> DataFrame:
    """F5 + F11: the normalised text of every row, words joined by one blank.

    Only tokens that changed (dictionary hits) are aggregated, as a list of
    (position, replacement), together with the row's position-0 token that
    carries the source text and the other columns.  The text is rebuilt from
    its own token array with the replacements applied, so the per-row
    aggregate (and, for large inputs, its shuffle) moves one row per text plus
    the few changed words instead of every token.

    ``keys`` are per-token columns that depend on the row (grouped alongside
    ``row_id``, so a partitioning by ``row_id`` still serves the grouping);
    other columns of ``order`` come from the carry struct, which must hold
    ``text_col``.  ``may_turn_blank``: replacements may be blank, so that a
    text is only known to be blank once it is rebuilt.
    """
    is_hit = F.col("stage").isin(*HIT_STAGES)
    rows = annotated.filter(is_hit | (F.col("pos") == 0))
    # the carried text is appended once; a buffer that holds it (first, max_by) would be copied for every hit of the row
    g = rows.groupBy(row_id, *keys).agg(
        F.collect_list(F.when(is_hit, F.struct("pos", "out_word"))).alias("_hits"),
        F.collect_list("_carry").alias("_carries"),
    )
    g = g.withColumn("_rows", F.size("_carries")).withColumn("_carry", F.get("_carries", F.lit(0)))
    src = F.col(f"_carry.{text_col}")
    g = g.withColumn("_hits", _once(row_id, F.col(row_id), F.col("_hits"))).filter(~tx.is_blank(src))
    g = g.withColumn("_text", _rebuilt(src, F.col("_hits")))
    g = g.filter(~tx.is_blank(F.col("_text"))) if may_turn_blank else g
    cols = [F.col(row_id)]
    for c in order:
        if c == text_col:
            cols.append(F.col("_text").alias(text_col))
        else:
            cols.append(F.col(c) if c in keys else F.col(f"_carry.{c}").alias(c))
    if original_col:
        cols.append(src.alias(original_col))
    return g.select(*cols)


def match_stats(annotated: DataFrame, by: list[str]) -> DataFrame:
    """A1: counters of the reference; stretch hits count as fuzzy (also shown apart)."""
    st = F.col("stage")
    return annotated.groupBy(*by).agg(
        F.count_if(st == "exact").cast("long").alias("exact_matches"),
        F.count_if(st.isin("fuzzy", "stretch")).cast("long").alias("fuzzy_matches"),
        F.count_if(st == "stretch").cast("long").alias("stretch_matches"),
        F.count_if(st == "none").cast("long").alias("no_matches"),
        F.count_if(st.isin("exact", "fuzzy", "stretch", "none")).cast("long").alias("total_words"),
    )
