"""Per-document text quality statistics, and the kind of text they tell.

The statistics are native column expressions. The kind comes from an ordered rule list, induced by
incremental reduced-error pruning on labelled documents: sentences and words of the table itself
are composed into prose, lists, tables and noise of known shares, with and without page layout. The
learned thresholds become one SQL CASE expression, which is applied to the statistics in the JVM.
One Arrow stage comes before: look-alikes and wrong encodings are undone in texts that hold other
than plain characters, so that the kind is that of the text as it was meant.

Defined results: null and empty texts have null kind and no statistics beyond 0; the opening lines
and code fences don't count; equal texts get equal kinds; whole texts are read.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclattice.llm import mojibake
from doclattice.llm.confusables import form
from doclattice.llm.readability import sentences

#: Results from which sentences for the labelled documents are taken: the lowest hashes.
SAMPLE_RESULTS = 500
LABELLED = 3_000
#: Syllables that count as common: the most frequent ones of all clean texts.
COMMON_SYLLABLES = 450
#: Words from which phrases are made: the most frequent ones of all clean texts.
COMMON_WORDS = 600
KINDS = ("table", "list", "junk")

# English function words and Korean endings that mark natural prose.
STOPWORDS = "the a an of to in and is are be for on with at by that this it as or from will can you if not have has was were please each every they which shall"
ENDINGS = "은 는 이 가 을 를 에 의 로 와 과 도 다 요 며 고 면 서 여 한 된 할 지"

# What a line is, beside the plain tests of ``_class``; possessive, so that no line is walked twice.
_GAPS = r"\S {2,}+\S(?:\S| \S)*+ {2,}+\S"
_FRAMED = r"^\s*+[|│┃].*[|│┃]\s*$"
_RULE = r"^[-─━:= ]*+[+|│┃┌┬┐├┼┤└┴┘][-+|│┃┌┬┐├┼┤└┴┘─━:= ]*+$"
_CELLS = r"^[^,]*+,[^ ,\"]*+(?:\"[^\"]*+\")?+[^,]*+,|\",|,\""
_MARK = r"^\s*(?:[-*+•○●·▪◦□■◆▶ㅇ]|[(]?(?:[0-9]{1,3}|[가-하]|[a-zA-Z]|[ivxIVX]{1,4})[.)]|[①-⓿㉠-㉻㈀-㈞])\s+\S"
_LEADER = r"(?:\.{3,}|…{2,}|·{3,})\s*[0-9]+\s*$"
_STOPS, _CLOSERS = (".", "!", "?", "。"), "\"'”’)]*_|│ "
_PAIR = r"^\s*+[^:|\t]{1,30}: [^:|\t]{1,40}$"
_OPENING = r"^- (?:원본 형식|변환기): "
#: Texts of these characters alone are in consistent form and rightly decoded.
_PLAIN = "[^\t\n\\x20-\\x7e가-힣]"


def _has(x: Column, *any_of: str) -> Column:
    out = x.contains(any_of[0])
    for s in any_of[1:]:
        out = out | x.contains(s)
    return out


def _ends(x: Column, *any_of: str) -> Column:
    out = x.endswith(any_of[0])
    for s in any_of[1:]:
        out = out | x.endswith(s)
    return out


def body(text: Column) -> Column:
    """The lines of a text in consistent form, without headings, the converter's lines and the marks of code fences."""
    lines = F.split(F.when(_has(text, "<br", "<BR", "<Br"), F.regexp_replace(text, r"(?i)<br ?/?>", "\n")).otherwise(text), "\n")

    def kept(x: Column) -> Column:
        start = F.ltrim(x)
        heading = start.startswith("#") & x.rlike(r"^\s*#{1,6} ")
        return x.rlike(r"\S") & ~(heading | x.startswith("- ") & x.rlike(_OPENING) | start.startswith("```") | start.startswith("~~~"))

    return F.filter(lines, kept)


def _len(c: Column) -> Column:
    for blank in " ", "\t", "\n", "\r":
        c = F.replace(c, F.lit(blank), F.lit(""))
    return F.length(c).cast("double")


def _class(x: Column, stop: Column) -> Column:
    """What one line is: row of a table, item of a list, short line, line that ends a sentence, other; ``stop``: whether a full stop ends it."""
    dump = x.rlike(r"^\s*[0-9a-f]{8} ") | ~x.rlike(r"[\p{L}\p{N}]") & ~x.rlike(_RULE)
    row = ~dump & (_has(x, "\t") | _has(x, "|", "│", "┃") & x.rlike(_FRAMED) | _has(x, "  ") & x.rlike(_GAPS) | x.rlike(_RULE))
    row = row | x.contains(",") & ~x.contains(", ") & ~stop & x.rlike(_CELLS)
    item = _has(x, "...", "……", "···") & x.rlike(_LEADER) | ~stop & (x.rlike(_MARK) | x.contains(": ") & x.rlike(_PAIR))
    short = (F.length(x) <= 34) & (F.size(F.split(F.trim(x), " +")) <= 4)
    return F.when(row, "r").when(item, "i").when(stop, "s").when(_has(x, ". ", "! ", "? "), "p").when(short, "w").otherwise("o")


def statistics(df: DataFrame, text: str = "markdown", common: str = "") -> DataFrame:
    """Adds the statistics of the column ``text``, which is in consistent form; shares are of the characters that are no blanks."""
    lines, words, b = F.col("_lines"), F.col("_words"), F.col("_flat")
    n = F.greatest(F.col("n_chars"), F.lit(1))
    n_words = F.greatest(F.size(words), F.lit(1))
    n_lines = F.greatest(F.size(lines), F.lit(1))
    share = lambda c: F.round(c / n, 4)
    per_word = lambda c: F.round(c / n_words, 4)
    of = lambda *k: share(F.aggregate("_lines", F.lit(0.0), lambda s, x: s + F.when(x["k"].isin(*k), x["n"]).otherwise(0.0)))
    stop_words, endings = STOPWORDS.split(), ENDINGS.split()
    out = (
        df.withColumn("_raw", body(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_stops", F.transform("_raw", lambda x: F.struct(x.alias("x"), _ends(F.rtrim(x, F.lit(_CLOSERS)), *_STOPS).alias("stop"))))
        .withColumn("_lines", F.transform("_stops", lambda r: F.struct(_len(r["x"]).alias("n"), _class(r["x"], r["stop"]).alias("k"))))
        .withColumn("_flat", F.array_join("_raw", "\n"))
        .withColumn("_words", F.filter(F.split("_flat", r"\s+"), lambda x: x != ""))
        .withColumn("n_chars", _len(F.col("_flat")))
    )
    hangul = F.greatest(F.length(F.regexp_replace(b, "[^가-힣]++", "")).cast("double"), F.lit(1.0))

    bare = F.transform(words, lambda w: F.trim(w, F.lit(".,:;!?\"'()*")))
    usual = lambda w: F.substring(w, -1, 1).isin(*endings) | F.lower(w).isin(*stop_words)

    def code(w: Column) -> Column:
        """Words that are no words: bytes and places in hexadecimal, glyph numbers, long runs of letters and digits."""
        size = F.length(w)
        return size.isin(2, 8) & w.rlike("^(?=[a-f]*[0-9])[0-9a-f]+$") | (size >= 25) & w.rlike("^[A-Za-z0-9+/=]++$") | w.startswith("(cid:")

    letters_of = lambda test: F.aggregate(F.filter(words, test), F.lit(0), lambda s, w: s + F.length(w))

    return out.withColumns(
        {
            "n_lines": F.size(lines).cast("double"),
            "n_words": F.size(words).cast("double"),
            "mean_word": F.round(F.col("n_chars") / n_words, 4),
            "symbol_share": share(F.length(F.regexp_replace(b, r"[\p{L}\p{N}\s]++", ""))),
            "digit_share": share(F.length(F.regexp_replace(b, "[^0-9]++", ""))),
            "row_share": of("r"),
            "item_share": of("i"),
            "short_share": of("w"),
            "stop_lines": F.round(F.size(F.filter(lines, lambda x: x["k"] == "s")) / n_lines, 4),
            "stop_share": of("s", "p"),
            "long_share": of("s", "p", "o"),
            "common_words": per_word(F.size(F.filter(bare, usual))),
            "distinct_words": F.round(F.size(F.array_distinct(words)) / n_words, 4),
            "lone_chars": per_word(F.size(F.filter(words, lambda x: (F.length(x) == 1) & ~x.rlike("[0-9|│OXaAI○•*-]")))),
            "run_share": share(F.lit(1.0) * F.length(b) - F.length(F.regexp_replace(b, r"([^\s.|-])\1{4,}+", ""))),
            "code_share": share(letters_of(code)),
            "odd_letters": share(F.length(F.regexp_replace(b, r"[^ㄱ-ㆎ]++", "")) + letters_of(lambda w: (F.length(w) >= 4) & w.rlike("^[b-df-hj-np-tv-xz]++$"))),
            "rare_syllables": F.round(F.length(F.regexp_replace(F.translate(b, common, ""), "[^가-힣]++", "")) / hangul, 4) if common else F.lit(0.0),
        }
    ).drop("_raw", "_stops", "_lines", "_flat", "_words")


STATISTICS = (
    "n_chars", "n_lines", "n_words", "mean_word", "symbol_share", "digit_share", "row_share", "item_share", "short_share", "stop_lines", "stop_share", "long_share",
    "common_words", "distinct_words", "lone_chars", "run_share", "code_share", "odd_letters", "rare_syllables",
)
#: What the rules may test: shares alone, so that a rule means the same for a short and a long text.
TESTED = STATISTICS[3:]


def compose(prose: list[str], words: list[str], n: int, seed: int = 5) -> list[tuple[str, str]]:
    """Labelled documents (text, kind) of known shares, from the table's own sentences and words."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    pools = [p for p in ([w for w in words if w.isascii()], [w for w in words if not w.isascii()]) if len(p) > 5] or [words]
    pool_of = pools[0]

    def phrase() -> str:
        return " ".join(rng.choice(pool_of) for _ in range(rng.randint(1, 3)))

    fillers = (
        phrase, phrase, lambda: str(rng.randint(1, 99999)), lambda: f"{rng.random() * 900:.2f}", lambda: rng.choice(("O", "X", "-", "", "TRUE", "FALSE")),
        lambda: f"{rng.choice('ABKR')}-{rng.randint(0, 999):03d}", lambda: f"20{rng.randint(10, 30)}년 {rng.randint(1, 12)}월 {rng.randint(1, 28)}일",
    )

    def some_prose(size: int) -> str:
        out: list[str] = []
        while sum(map(len, out)) < size:
            out.append(rng.choice(prose))
        text, width = "", rng.choice((0, 0, 28, 60))
        for s in out:
            text += s + rng.choice((" ", " ", " ", "\n", "\n\n"))
        if width:
            text = re.sub(f"(.{{{width},{width + 14}}}?) ", "\\1\n", text)
        return text.strip()

    def some_list(size: int) -> str:
        kind, out = rng.randrange(8), []
        while sum(map(len, out)) < size:
            k = len(out)
            body = phrase()
            out.append((f"{rng.choice('-*•')} {body}", f"{k + 1}. {body}", f"{'가나다라마바사아자차카타파하'[k % 14]}. {body}", f"{chr(0x2460 + k % 20)} {body}", f"{'  ' * rng.randint(0, 2)}{rng.choice('*○-')} {body}", f"{body} {'.' * rng.randint(5, 40)} {k * 2 + 1}", f"{body}: {phrase()}", body)[kind])
        return "\n".join(out)

    def some_table(size: int) -> str:
        kind, width, out = rng.randrange(6), rng.randint(2, 8), []
        if kind == 0:
            out = ["| " + " | ".join(f"열{k}" for k in range(width)) + " |", "|" + " --- |" * width]
        columns = [phrase, *(rng.choice(fillers[: 7 if rng.random() < 0.7 else 2] + fillers[4:5]) for _ in range(max(2, width - 1)))]
        while sum(map(len, out)) < size:
            r = [f() for f in columns]
            out.append((lambda: "| " + " | ".join(r) + " |", lambda: "\t".join(r), lambda: ",".join(f'"{x}"' if " " in x else x for x in r), lambda: "".join(f"{x[:14]:<16}" for x in r).rstrip(), lambda: "│" + "│".join(f"{x[:12]:<12}" for x in r) + "│", lambda: "+" + "+".join("-" * 12 for _ in r) + "+" if len(out) % 5 == 0 else "|" + "|".join(f"{x[:12]:<12}" for x in r) + "|")[kind]())
        return "\n".join(out)

    def some_junk(size: int) -> str:
        kind, out, one = rng.randrange(9), [], phrase()
        pool = rng.sample("ㄱㄴㄷㅏㅗㅣ.,;'`~|0359abkz!?", 16)
        while sum(map(len, out)) < size:
            w = rng.randint(12, 60)
            out.append((
                lambda: " ".join(rng.choice(pool) for _ in range(w // 2)),
                lambda: " ".join(f"(cid:{rng.randint(1, 999)})" for _ in range(w // 5)),
                lambda: f"{len(out) * 16:08x}  " + " ".join(f"{rng.randrange(256):02x}" for _ in range(16)),
                lambda: rng.choice("ㅋㅎㅠ=_*-~#") * w,
                lambda: "".join(rng.choice(letters + letters.upper() + "0123456789+/") for _ in range(72)),
                lambda: "".join(chr(0xAC00 + rng.randrange(11172)) if rng.random() > 0.2 else " " for _ in range(w)),
                lambda: " ".join([one] * (w // 4)),
                lambda: "".join(rng.choice("!@#$%^&*[]{}<>/?:;~_-+=|") for _ in range(w)),
                lambda: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 11))) for _ in range(w // 6)),
            )[kind]())
        return "\n".join(out)

    makers = {"prose": some_prose, "list": some_list, "table": some_table, "junk": some_junk}
    docs = []
    for k in range(n):
        kind = ("prose", "list", "table", "junk", "prose")[k % 5]
        pool_of = rng.choice(pools)
        size = rng.choice((120, 300, 700, 1500))
        parts = [makers[kind](size)]
        if rng.random() < 0.5:
            other = rng.choice([x for x in makers if x != kind])
            parts.append(makers[other](int(size * rng.uniform(0.05, 0.6))))
            rng.shuffle(parts)
        docs.append(("\n\n".join(parts), kind))
    return docs


Rule = tuple[str, tuple[tuple[str, str, float], ...]]


def _covers(x: np.ndarray, conds: list[tuple[int, int, float]]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, sign, t in conds:
        hit &= x[:, f] > t if sign > 0 else x[:, f] <= t
    return hit


def induce(x: np.ndarray, y: np.ndarray, kinds: tuple[str, ...] = KINDS, seed: int = 3) -> list[Rule]:
    """Ordered rules by incremental reduced-error pruning: grow by information gain, prune on held-out documents, remove what is covered."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 60))) for f in range(x.shape[1])]
    for kind in kinds:
        failed = 0
        while failed < 5 and len(rules) < 40:
            pos = y == kind
            if pos.sum() < 5:
                break
            order = rng.permutation(len(x))
            grow, prune = order[: len(x) * 2 // 3], order[len(x) * 2 // 3 :]
            conds: list[tuple[int, int, float]] = []
            gx, gp = x[grow], pos[grow]
            live = np.ones(len(grow), bool)
            while live.any() and gp[live].mean() < 1 and len(conds) < 6:
                p0, n0 = gp[live].sum(), (~gp[live]).sum()
                if not p0:
                    break
                best = (0.0, None)
                for f in range(x.shape[1]):
                    v = gx[live, f]
                    above = v[:, None] > cuts[f][None, :]
                    p1, n1 = above[gp[live]].sum(axis=0), above[~gp[live]].sum(axis=0)
                    for sign, p, n in ((1, p1, n1), (-1, p0 - p1, n0 - n1)):
                        gain = p * (np.log2((p + 0.01) / (p + n + 0.01)) - np.log2(p0 / (p0 + n0)))
                        k = int(np.argmax(gain))
                        if gain[k] > best[0] + 1e-9:
                            best = (float(gain[k]), (f, sign, float(cuts[f][k])))
                if best[1] is None:
                    break
                conds.append(best[1])
                live = _covers(gx, conds)
            worth = lambda c: (lambda h: (pos[prune][h].sum() - (~pos[prune])[h].sum()) / max(h.sum(), 1))(_covers(x[prune], c))
            while len(conds) > 1 and worth(conds[:-1]) >= worth(conds):
                conds = conds[:-1]
            hit = _covers(x, conds)
            if not conds or worth(conds) <= 0.85 or not pos[hit].any():
                failed += 1  # another split may do better
                continue
            rules.append((kind, tuple((TESTED[f], ">" if s > 0 else "<=", round(t, 4)) for f, s, t in conds)))
            x, y = x[~hit], y[~hit]
    return rules


def case(rules: list[Rule]) -> str:
    """The rule list as one SQL CASE expression over the statistics."""
    when = " ".join(f"WHEN {' AND '.join(f'{f} {op} {t}' for f, op, t in conds)} THEN '{kind}'" for kind, conds in rules)
    return f"CASE WHEN n_chars = 0 THEN NULL {when} ELSE 'prose' END"


def _meant(results: DataFrame) -> DataFrame:
    """(res_id, markdown): texts as they were meant, in one scan; only those with other than plain characters are touched."""
    model = results.sparkSession.sparkContext.broadcast(mojibake.learn(results))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1)
            other = pc.match_substring_regex(text, _PLAIN)
            if pc.any(other).as_py():
                meant = [form(model.value.repair(t)[1]) for t in text.filter(other).to_pylist()]
                text = pc.replace_with_mask(text, other, pa.array(meant, text.type))
            yield pa.RecordBatch.from_arrays([b.column(0), text], names=["res_id", "markdown"])

    return results.select("res_id", "markdown").mapInArrow(run, "res_id bigint, markdown string")


def common_words(results: DataFrame) -> tuple[list[str], str]:
    """(most frequent words, most frequent syllables) of the sentences of all clean texts."""
    ending = re.compile("(?:" + ENDINGS.replace(" ", "|") + ")$")
    stop_words = set(STOPWORDS.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = Counter(w for t in mojibake.clean(b.column(0)) for s in sentences(t) for w in s.split())
            words: Counter[str] = Counter()
            syllables: Counter[str] = Counter()
            for w, n in raw.items():
                for c in w:
                    if "가" <= c <= "힣":
                        syllables[c] += n
                w = w.strip(".,()\"'")
                if w not in stop_words:
                    words[ending.sub("", w) if len(w) > 2 else w] += n
            both = [("word", x, n) for x, n in words.items()] + [("syllable", x, n) for x, n in syllables.items()]
            if both:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*both, strict=True)], names=["kind", "x", "n"])

    counts = results.where("markdown is not null").select("markdown").mapInArrow(run, "kind string, x string, n bigint").groupBy("kind", "x").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "x"))
    top = counts.withColumn("place", place).where(F.col("place") <= F.when(F.col("kind") == "word", COMMON_WORDS).otherwise(COMMON_SYLLABLES)).collect()
    words = sorted(r.x for r in top if r.kind == "word" and len(r.x) > 1 and not r.x[0].isdigit())
    return words, "".join(sorted(r.x for r in top if r.kind == "syllable"))


def learn(results: DataFrame) -> tuple[list[Rule], str]:
    """(rules, common syllables): words and syllables of all clean texts, sentences of a bounded sample."""
    texts = mojibake.clean_sample(results, SAMPLE_RESULTS)
    prose = sorted({s for t in texts for s in sentences(t)}) or ["문장이 없습니다.", "There is no sentence here."]
    words, common = common_words(results)
    words = words or ["낱말", "word"]
    docs = compose(prose, words, LABELLED)
    frame = results.sparkSession.createDataFrame([(t, k) for t, k in docs], "markdown string, kind string")
    got = statistics(frame, "markdown", common).select("kind", *TESTED).toPandas()
    return induce(got[list(TESTED)].to_numpy(float), got["kind"].to_numpy()), common


def kinds(results: DataFrame, all_statistics: bool = True) -> DataFrame:
    """One row per result with text: its statistics, or those alone that the rules test, and the kind they tell. No shuffle."""
    rules, common = learn(results)
    tested = {f for _, conds in rules for f, _, _ in conds} | {"n_chars"}
    wanted = [f for f in STATISTICS if all_statistics or f in tested]
    texts = _meant(results.where("markdown is not null and markdown <> ''"))
    each = statistics(texts, "markdown", common)
    # a generator keeps filters on the kind from being pushed below, where every rule would compute its statistics again
    once = each.select("res_id", F.explode(F.array(F.struct(*wanted))).alias("s")).select("res_id", "s.*")
    return once.withColumn("text_kind", F.expr(case(rules)))


def found(results: DataFrame) -> DataFrame:
    """(res_id, text_kind) of lists, tables and junk."""
    return kinds(results, all_statistics=False).where("text_kind <> 'prose'").select("res_id", "text_kind")
