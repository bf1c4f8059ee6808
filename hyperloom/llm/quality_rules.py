"""Quality rules as weak supervision (DataFrame expressions only).

Each rule votes good (1), bad (-1) or abstains (0). Votes are summed up as counts of vote patterns, of which there
are at most 3 to the number of rules; expectation-maximisation on these counts estimates, for a latent good or bad class, how
often each rule casts each vote (its accuracy in either class), and the posterior probability of good decides.

Null texts count as empty. Empty texts have no words and fail the base rule. An empty table gives an empty result. Rows are
judged one by one, so repeated rows get equal results; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.llm.storage import materialize

#: Rule -> (good if, bad if), over the columns of ``metrics``; the same text runs in Spark SQL and DuckDB.
RULES = {
    "symbols": ("n_symbols * 50 <= n_words", "n_symbols * 10 >= n_words"),
    "bare_symbols": ("n_bare_symbols * 100 <= n_words", "n_bare_symbols * 20 >= n_words"),
    "decorations": ("n_decorations * 100 <= n_words", "n_decorations * 20 >= n_words"),
    "word_length": ("word_chars BETWEEN n_words * 3 AND n_words * 9", "word_chars < n_words * 2 OR word_chars > n_words * 14"),
    "repetition": ("n_repeat_words * 10 <= n_words", "n_repeat_words * 10 >= n_words * 3"),
    "duplicate_lines": ("n_dup_lines = 0 AND n_lines > 1", "n_dup_lines * 10 >= n_lines * 3 AND n_dup_lines > 0"),
    "capitals": ("n_capital_runs * 50 <= n_words", "n_capital_runs * 5 >= n_words"),
    "exclamation": ("n_bangs * 100 <= n_words", "n_bangs * 10 >= n_words"),
    "line_ends": ("n_ended_lines * 10 >= n_lines * 6", "n_ended_lines * 10 <= n_lines"),
    "variety": ("n_distinct_words * 10 >= n_words * 3", "n_distinct_words * 10 <= n_words * 2 AND n_words <= 2000"),
}
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: Start of the estimation: how often a rule votes (good, bad), in either class. Rules about marks hardly ever vote bad on good texts; those about
#: the shape of lines do now and then.
_MARKS, _WORDS, _LINES = ((0.8, 0.004), (0.6, 0.3)), ((0.8, 0.004), (0.65, 0.25)), ((0.7, 0.01), (0.6, 0.2))
START = {
    "symbols": _MARKS, "bare_symbols": _MARKS, "decorations": _MARKS, "word_length": _WORDS, "repetition": _WORDS, "duplicate_lines": _LINES, "capitals": _WORDS,
    "exclamation": _WORDS, "line_ends": _LINES, "variety": _WORDS,
}
START_PRIOR, ROUNDS, SMOOTHING, KEEP_FROM = 0.85, 10, 1.0, 0.5
#: The start also counts as so many texts of either class beside those seen: bad texts come in several kinds, of which each breaks few rules, and without it the
#: estimates of a small table may take one kind for the whole bad class. It loses weight as texts grow in number.
PRIOR_TEXTS = 50


def metrics(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of each whole text that the rules look at; no shuffle.

    Repeated three-word windows are found by sorting, per text, one long per window: a hash above, the position in
    the low bits (as many as the number of words needs). Those that share a hash are then compared as words.
    """
    word = r"[^\\x20\\x09-\\x0D]"
    step = docs.select(F.col(ident).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    step = step.selectExpr(
        "doc_id", "t", f"regexp_extract_all(t, '{word}+', 0) AS words", f"filter(split(t, '\\n', -1), l -> l RLIKE '{word}') AS lines"
    )
    step = step.selectExpr("doc_id", "t", "words", "lines", "array_join(words, '') AS joined", "size(words) AS n", "length(bin(size(words))) AS b")
    step = step.selectExpr(
        "doc_id", "t", "words", "lines", "joined", "n", "b",
        """CASE WHEN n >= 3 THEN sort_array(transform(slice(words, 1, n - 2),
             (w, i) -> shiftleft(shiftright(xxhash64(w, words[i + 1], words[i + 2]), b), b) | CAST(i AS BIGINT)))
           ELSE array() END AS windows""",
    )
    step = step.selectExpr(
        "doc_id", "t", "words", "lines", "joined", "n", "shiftleft(1L, b) - 1 AS low",
        """filter(windows, (x, i) -> (i > 0 AND shiftright(x, b) = shiftright(windows[i - 1], b))
             OR (i < size(windows) - 1 AND shiftright(x, b) = shiftright(windows[i + 1], b))) AS hits""",
    )
    step = step.selectExpr(
        "doc_id", "t", "words", "lines", "joined", "n",
        "sort_array(transform(hits, x -> struct(concat_ws(' ', slice(words, CAST(x & low AS INT) + 1, 3)) AS w, x & low AS i))) AS same",
    )
    step = step.selectExpr(
        "doc_id", "t", "words", "lines", "joined", "n",
        "filter(same, (x, k) -> (k > 0 AND x.w = same[k - 1].w) OR (k < size(same) - 1 AND x.w = same[k + 1].w)).i AS again",
    )
    return step.selectExpr(
        "doc_id",
        "CAST(n AS BIGINT) AS n_words",
        "CAST(length(joined) AS BIGINT) AS word_chars",
        "CAST(length(joined) - length(translate(joined, '#*$%&|<>', '')) AS BIGINT) AS n_symbols",
        "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT) AS n_dup_lines",
        "CAST(size(array_distinct(flatten(transform(again, x -> array(x, x + 1, x + 2))))) AS BIGINT) AS n_repeat_words",
        "CAST(size(lines) AS BIGINT) AS n_lines",
        "CAST(regexp_count(t, '[A-ZÀ-ÖØ-Þ]{3,}') AS BIGINT) AS n_capital_runs",
        "CAST((length(t) - length(replace(t, '!!', ''))) / 2 AS BIGINT) AS n_bangs",
        r"CAST(size(filter(lines, l -> l RLIKE '[.!?][\\x20\\x09-\\x0D]*$')) AS BIGINT) AS n_ended_lines",
        "CAST(size(array_distinct(words)) AS BIGINT) AS n_distinct_words",
        "CAST(regexp_count(t, '[\\n ][|#*$%&<>]+ ') AS BIGINT) AS n_bare_symbols",
        "CAST(regexp_count(t, '[#*$%&<>]{3}') AS BIGINT) AS n_decorations",
    )


def vote(good: str, bad: str) -> str:
    return f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"


@dataclass
class VoteModel:
    """prior = P(good); rates[rule] = ((P(1|good), P(-1|good)), (P(1|bad), P(-1|bad)))."""

    prior: float
    rates: dict[str, tuple[tuple[float, float], tuple[float, float]]]

    def log_odds(self) -> Column:
        """Posterior log odds of good, over columns named like the rules."""
        total = F.lit(self.prior).cast("double")
        total = F.log(total) - F.log(F.lit(1.0) - total)
        for rule, ((gp, gn), (bp, bn)) in self.rates.items():
            column = F.col(rule)
            ratio = F.when(column == 1, F.lit(gp) / F.lit(bp)).when(column == -1, F.lit(gn) / F.lit(bn)).otherwise(F.lit(1 - gp - gn) / F.lit(1 - bp - bn))
            total = total + F.log(ratio)
        return total

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds()))


def fit(patterns: DataFrame, rules: list[str], rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over (rules..., n). Only sums leave Spark: a few numbers for each rule."""
    start = {r: START.get(r, _WORDS) for r in rules}
    model = VoteModel(START_PRIOR, start)
    for _ in range(rounds):
        weighted = patterns.withColumn("q", model.probability())
        sums = [F.sum("n").alias("all"), F.sum(F.col("n") * F.col("q")).alias("good")]
        for r in rules:
            for v, name in ((1, "up"), (-1, "down")):
                sums += [
                    F.sum(F.when(F.col(r) == v, F.col("n") * F.col("q")).otherwise(0.0)).alias(f"{r}_{name}_good"),
                    F.sum(F.when(F.col(r) == v, F.col("n") * (1 - F.col("q"))).otherwise(0.0)).alias(f"{r}_{name}_bad"),
                ]
        s = weighted.agg(*sums).first()
        if not s["all"]:
            return model
        good, bad = s["good"], s["all"] - s["good"]
        rate = lambda hits, total, prior: (hits + PRIOR_TEXTS * prior) / (total + PRIOR_TEXTS)
        model = VoteModel(
            (good + SMOOTHING) / (s["all"] + 2 * SMOOTHING),
            {r: tuple((rate(s[f"{r}_up_{c}"], t, start[r][k][0]), rate(s[f"{r}_down_{c}"], t, start[r][k][1])) for k, (c, t) in enumerate((("good", good), ("bad", bad)))) for r in rules},
        )
    return model


def judge(docs: DataFrame, ident: str = "doc_id", text: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, the posterior ``quality_prob`` and ``kept``."""
    rules = list(RULES)
    table = materialize(metrics(docs, ident, text), "quality-metrics")
    votes = table.select("*", *[F.expr(vote(*RULES[r])).alias(r) for r in rules])
    patterns = materialize(votes.where(f"NOT ({BASE_FAILED})").groupBy(*rules).agg(F.count("*").alias("n")), "vote-patterns")
    model = fit(patterns, rules)
    scored = votes.withColumn("quality_prob", model.probability()).withColumn("base_failed", F.expr(BASE_FAILED))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("quality_prob") >= keep_from)).alias("kept"), F.round("quality_prob", 4).alias("quality_prob"),
    )


def oracle() -> str:
    """The same in DuckDB SQL: base counts by list functions and windows, estimation rounds unrolled."""
    rules = list(RULES)
    word = r"[^\x20\x09-\x0D]"
    parts = [
        "base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)",
        f"w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}+') AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{word}')) AS lines FROM base)",
        "tri AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3)",
        "win AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS c FROM tri)",
        "rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY r)",
        f"""m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
            length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
            coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]{{3,}}'))::BIGINT AS n_capital_runs,
            ((length(t) - length(replace(t, '!!', ''))) // 2)::BIGINT AS n_bangs,
            len(list_filter(lines, lambda l: regexp_matches(l, '[.!?][\\x20\\x09-\\x0D]*$')))::BIGINT AS n_ended_lines,
            len(list_distinct(words))::BIGINT AS n_distinct_words, len(regexp_extract_all(t, '[\\n ][|#*$%&<>]+ '))::BIGINT AS n_bare_symbols,
            len(regexp_extract_all(t, '[#*$%&<>]{{3}}'))::BIGINT AS n_decorations FROM w LEFT JOIN rep USING (r))""",
        "v AS (SELECT *, " + ", ".join(f"{vote(*RULES[r])} AS {r}" for r in rules) + " FROM m)",
        f"pat AS (SELECT {', '.join(rules)}, count(*)::DOUBLE AS n FROM v WHERE NOT ({BASE_FAILED}) GROUP BY ALL)",
    ]
    names = [(r, k, v, f"{r}_{'ud'[v]}{'gb'[k]}") for r in rules for v in (0, 1) for k in (0, 1)]
    first = ", ".join(f"{START[r][k][v]}::DOUBLE AS {name}" for r, k, v, name in names)
    parts.append(f"p0 AS (SELECT {START_PRIOR}::DOUBLE AS prior, {first})")
    odds = "ln(prior) - ln(1 - prior) + " + " + ".join(
        f"ln(CASE {r} WHEN 1 THEN {r}_ug / {r}_ub WHEN -1 THEN {r}_dg / {r}_db ELSE (1 - {r}_ug - {r}_dg) / (1 - {r}_ub - {r}_db) END)" for r in rules
    )
    for k in range(ROUNDS):
        parts.append(f"q{k} AS (SELECT {', '.join(rules)}, n, 1 / (1 + exp(-({odds}))) AS q FROM pat, p{k})")
        cells = ", ".join(
            f"(sum(CASE WHEN {r} = {(1, -1)[v]} THEN n * {('q', '(1 - q)')[c]} ELSE 0 END) + {PRIOR_TEXTS * START[r][c][v]}) / (sum(n * {('q', '(1 - q)')[c]}) + {PRIOR_TEXTS}) AS {name}" for r, c, v, name in names
        )
        parts.append(f"p{k + 1} AS (SELECT (sum(n * q) + {SMOOTHING}) / (sum(n) + {2 * SMOOTHING}) AS prior, {cells} FROM q{k})")
    parts.append(f"s AS (SELECT v.*, 1 / (1 + exp(-({odds}))) AS q, ({BASE_FAILED}) AS base_failed FROM v, p{ROUNDS})")
    return (
        "WITH " + ", ".join(parts) + f" SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,"
        f" (NOT base_failed AND q >= {KEEP_FROM}) AS kept, round(q, 4) AS quality_prob FROM s"
    )
