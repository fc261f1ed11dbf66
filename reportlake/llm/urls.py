"""URL filter: host word segmentation and multinomial naive Bayes, behind a rule list.

A rule (host and path) fits its host and all subdomains if the path of the url
starts with the rule's; the longest rule that fits decides. Other urls are
judged by the method: a unigram Viterbi splits each run of letters of host and
path into words, and naive Bayes scores the words.

Both are learned from the table. The lexicon and its counts are the words of all
pages' texts. The labelled examples are all urls that a rule decides, with its
verdict and without the part of host and path that the rule fits, nor words that
any rule names (else the model would learn the rules by heart), and two short
lists of words. A host counts once for a word and a verdict, so that one with
many pages does not speak for all. Words that no example holds have no say.

A url that is null or without `://` has an empty host and path, no rule and no
words: the prior decides, which allows. Repeated rows are judged alike; empty
tables give no rows; null ids are kept as they are; other columns are not read.
Of rules of one length that fit, the one that sorts last decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.llm.common import drop, save

#: verdict, host, path
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: Labelled examples that no table need hold, as words that stand alone in hosts and paths, and that can be joined without a mark.
BLOCKED = """casino win poker slots jackpot bet betting bonus gamble roulette lottery cheap pills pharmacy viagra drugs meds
loans payday credit free prize winner click ads ad track tracker tracking banner popup spam adult xxx porn sex cams dating hot
warez crack keygen torrent pirate download replica fake rolex malware phish hack""".split()
ALLOWED = """docs wiki school university college library museum science research journal health
city gov data open source code dev project community events travel food recipes music art books garden sport weather
history culture education support help about contact learn guide maps photo home world daily times local""".split()
COMMON = "www m blog news forum shop store com org net example html index page the and of in to for on best my online web site article post en de fr es it".split()
PRIOR_BLOCK = 0.2
EVIDENCE = 30  # examples that each word of the lists stands for
SMOOTHING = 5  # examples of each class that every word is taken to have had before: a few hosts decide nothing
LEXICON = 50_000  # words of the texts that hosts are split into, at most, the most frequent
VOCABULARY = 50_000  # words of labelled urls that have a weight, at most, the most frequent
LETTERS = re.compile(r"[a-z]+")
LONGEST = 24  # characters of a word
CACHE = 500_000


@dataclass
class Segmenter:
    logs: dict[str, float]
    total: float

    def split(self, run: str) -> list[str]:
        """The most probable words of a run of letters; an unknown word of n letters is as rare as one count in 10 to the n."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(run) + 1):
            here = (-math.inf, 0)
            for at in range(max(0, end - LONGEST), end):
                word = run[at:end]
                score = best[at][0] + self.logs.get(word, -math.log(self.total) - len(word) * math.log(10))
                if score > here[0]:
                    here = (score, at)
            best.append(here)
        words, end = [], len(run)
        while end:
            at = best[end][1]
            words.append(run[at:end])
            end = at
        return words[::-1]


@dataclass
class Bayes:
    weight: dict[str, float]  # of a word for blocking
    prior: float

    def score(self, words: list[str]) -> float:
        """Log-odds for blocking."""
        return self.prior + sum(self.weight.get(w, 0.0) for w in words)


def segmenter(counts: dict[str, int]) -> Segmenter:
    """Unigram log-probabilities of the words counted and of the lists; a word of the lists counts as often as the mean word at least."""
    mean = sum(counts.values()) / len(counts) if counts else 1.0
    lexicon = counts | {w: max(mean, counts.get(w, 0)) for w in (*BLOCKED, *ALLOWED, *COMMON)}
    total = float(sum(lexicon.values()))
    return Segmenter({w: math.log(n / total) for w, n in lexicon.items()}, total)


def bayes(counts: dict[str, tuple[int, int]], prior: float = PRIOR_BLOCK) -> Bayes:
    """Multinomial naive Bayes from how often each word is in blocked and in allowed examples."""
    seen = {w: list(c) for w, c in counts.items()}
    for words, side in ((BLOCKED, 0), (ALLOWED, 1)):
        for w in words:
            seen.setdefault(w, [0, 0])[side] += EVIDENCE
    size = [sum(c[k] for c in seen.values()) + SMOOTHING * len(seen) for k in (0, 1)]
    weight = {w: math.log((c[0] + SMOOTHING) / size[0]) - math.log((c[1] + SMOOTHING) / size[1]) for w, c in seen.items()}
    return Bayes(weight, math.log(prior / (1 - prior)))


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]+", lambda m: m.group().lower(), host), path


def rule_of(host: str, path: str, rules=RULES) -> tuple[str, str, str, str] | None:
    """The longest rule that fits, as text, its verdict, and host and path without what it names."""
    fit = [(len(h) + len(p), h + p, v, host[: len(host) - len(h)], path[len(p) :]) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else None


def words_in(text: Column) -> Column:
    """Words of a page: runs of a to z outside of tags, scripts and styles, and of names with a dot inside such as hosts."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " "), r"\S*\w\.\w\S*", " ")
    return F.filter(F.split(F.lower(plain), "[^a-z]+"), lambda w: (w != "") & (F.length(w) <= LONGEST))


def most_frequent(counts: DataFrame, n: str, rows: int) -> list:
    """The rows of counts that are above some count, `rows` at most: no more than these, and a histogram, reach the driver."""
    spark = counts.sparkSession
    kept = save(spark, counts.withColumn("__level", F.floor(16 * F.log(n))), "counts")
    left, least = rows, None
    for level in sorted(kept.groupBy("__level").count().collect(), reverse=True):  # some hundred levels
        left -= level["count"]
        if left < 0:
            break
        least = level["__level"]
    found = [] if least is None else kept.where(F.col("__level") >= least).collect()
    drop(spark, kept)
    return found


def counted(texts: DataFrame, text: str) -> dict[str, int]:
    """How often each word is in all texts; of words seen more than once the most frequent, LEXICON at most."""
    found = texts.select(F.explode(words_in(texts[text])).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return {r["w"]: r["n"] for r in most_frequent(found, "n", LEXICON)}


def splitter(cut: Segmenter):
    """A function from a text to its words; it keeps the splits of runs it has met."""
    known: dict[str, list[str]] = {}

    def words(text: str) -> list[str]:
        if len(known) > CACHE:
            known.clear()
        out = []
        for r in LETTERS.findall(text.lower()):
            if r not in known:
                known[r] = cut.split(r)
            out += known[r]
        return out

    return words


def examples(urls: DataFrame, cut: Segmenter, *, url: str = "url", rules=RULES) -> DataFrame:
    """host, blocked and word, once each, of the urls that a rule decides."""
    named = {w for _, h, p in rules for w in LETTERS.findall(h + p)}

    @F.pandas_udf("host string, blocked boolean, words array<string>")
    def labelled(parts_: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = splitter(cut)
        for part in parts_:
            rows = []
            for u in part:
                host, path = parts(u if isinstance(u, str) else None)
                found = rule_of(host, path, rules)
                rows.append((host, found[1] == "block", sorted({*words(found[2]), *words(found[3])} - named)) if found else (None, None, None))
            yield pd.DataFrame(rows, columns=["host", "blocked", "words"])

    found = urls.select(labelled.asNondeterministic()(urls[url]).alias("x")).where("x.host is not null")
    return found.select("x.host", "x.blocked", F.explode("x.words").alias("word")).distinct()


def learn(some: DataFrame) -> dict[str, tuple[int, int]]:
    """How many hosts hold each word in blocked and in allowed examples; the most frequent words, VOCABULARY at most."""
    count = some.groupBy("word").agg(F.count_if(F.col("blocked")).alias("b"), F.count_if(~F.col("blocked")).alias("a"))
    return {r["word"]: (r["b"], r["a"]) for r in most_frequent(count.withColumn("n", F.col("a") + F.col("b")), "n", VOCABULARY)}


def judge(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", text: str | None = "html", rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row, the host's words, and what the words score for blocking (log-odds). text: the column of the pages' texts, if there is one."""
    cut = segmenter(counted(pages, text) if text else {})
    model = bayes(learn(examples(pages, cut, url=url, rules=rules)))

    @F.pandas_udf("host string, path string, rule string, verdict string, host_words string, score double")
    def judged(parts_: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = splitter(cut)
        for part in parts_:
            rows = []
            for u in part:
                host, path = parts(u if isinstance(u, str) else None)
                found = rule_of(host, path, rules)
                of_host = words(host)
                score = model.score(of_host + words(path))
                rows.append((host, path, found[0] if found else None, found[1] if found else "block" if score > 0 else "allow", " ".join(of_host), score))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "host_words", "score"])

    return pages.select(pages[page_id].alias("page_id"), judged.asNondeterministic()(pages[url]).alias("j")).select("page_id", "j.*")
