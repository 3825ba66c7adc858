"""Abusive, hateful and sexually explicit language by weak supervision.

Every sentence of every document is shown to the VOTERS: lexicons and patterns that vote for a category, against it, or
not at all. For each category a generative label model is fitted to the counts of all vote patterns by expectation
maximisation: it estimates how often each voter is right in either class, and from what votes agree beyond that, which
voters are correlated; correlated voters share their weight. Its posteriors label the sentences on which a linear
classifier over hashed words and word pairs is trained, so that a document is judged by more than the lists. A document
has a category if one of its sentences is scored CUT or more.

The counts cover all documents. The classifier is fitted on at most FIT sentences with votes (those of least
hash), FIT without (the most frequent of a hash sample) and the labelled samples: FIT is the documented bound of what reaches the driver. Vote patterns are at most
three to the power of a category's voters.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.words import folded, mended
from kinloom.session import Scratch

CATEGORIES = ("abuse", "hate", "sexual")
FIT = 20_000
CUT = 0.42
BITS = 17
SAMPLE_WEIGHT = 3.0
GOLD_WEIGHT = 5.0
# A voter against a category is taken to be wrong on at most this share of its cases.
AGAINST = 0.02

# Letters of other scripts and signs that are drawn like Latin letters.
LOOKALIKE = str.maketrans("аеорсухіјѕкмтвнԁοαειρυ", "aeopcyxijskmtbhdoaeipu")
OTHER_SCRIPT = re.compile("[\u0370-\u052f]")
SIGNS = str.maketrans("013457@$!|", "oieastasil")
# The voters' words.
INSULTS = """idiot idiots moron morons cretin cretins imbecile imbeciles loser losers halfwit dimwit nitwit dumbass asshole assholes arsehole bastard bitch
scumbag scum trash scumbags prick dickhead wanker twat cunt douchebag jackass fool coward liar pig parasite vollidiot idioten trottel arschloch wichser
hurensohn spast depp imbecil idiota estupido gilipollas cabron pendejo connard connasse salaud salope abruti debile encule batard slut whore retard""".split()
SLIGHTS = """worthless pathetic disgusting brainless stupid dumb dumbest useless lying ugly miserable filthy rotten vile spineless clueless ignorant wertloser
dummer widerlicher erbarmlicher inutil asqueroso patetico pathetique minable sale stupide debil typical mediocre vergognosa""".split()
YOU = "you your yours yourself u ur du dich dir dein deine ta toi tu ton te eres tus ti".split()
DEHUMAN = """vermin filth subhuman mongrel mongrels rats plague parasites cockroaches inferior savages thieves animals dirt disease ungeziefer untermenschen abschaum
parasitos ratas alimanas vermine racaille sousrace scum""".split()
GROUPS = """immigrants migrants believers foreigners refugees natives race races tribe people peoples jews muslims christians hindus gypsies blacks gays lesbians
women auslander immigres inmigrantes extranjeros etrangers kind""".split()
EXPLICIT = """porn porno nude nudes horny fuck fucked fucking fucks pussy cock dick tits boobs blowjob handjob cumshot cum orgasm orgasms masturbate masturbating
masturbation anal xxx hardcore uncensored slutty milf threesome gangbang dildo nackt stohnend ficken fickt gefickt nue nus baiserent baiser baise desnuda desnudas
desnudos follar follaron follando polvo coito erection genitals nipples penis vagina aroused camgirls swingers sexting naked moaned moaning licked thighs""".split()
LEXICON = {w for ws in (INSULTS, SLIGHTS, DEHUMAN, EXPLICIT) for w in ws}
BY_SIZE: dict[int, list[str]] = {}
for _w in sorted(LEXICON):
    BY_SIZE.setdefault(len(_w), []).append(_w)

MARKED = re.compile(r"[a-z0-9@$*!|]*[@$*|][a-z0-9@$*!|]*")
INSIDE = re.compile(r"(?<=[a-z])[013457!](?=[a-z])|\b[013457](?=[a-z]{3})")
DOTTED = re.compile(r"\b(?:[a-z0-9][.\-_*]){2,}[a-z0-9]\b|\b(?:[a-z] ){3,}[a-z]\b")
LONG = re.compile(r"([a-z])\1{2,}")
WORDS = re.compile(r"[a-z0-9']+")
SENTENCE = re.compile(r"(?<=[.!?…])[\s\"”»']+|\n+")


def _any(ws: list[str]) -> str:
    return r"\b(?:" + "|".join(ws) + r")\b"


def _near(a: str, b: str, n: int = 60) -> str:
    return f"(?:(?:{a}).{{0,{n}}}?(?:{b})|(?:{b}).{{0,{n}}}?(?:{a}))"


INSULT, SLIGHT, YOURS, SEX = _any(INSULTS), _any(SLIGHTS), _any(YOU), _any(EXPLICIT)
LOW, WHO = _any(DEHUMAN), _any(GROUPS)
SOLICIT = _any("watch download live send click video tape pics photos clips cams message explicit leaked scenes".split())
CALM = (r"bastard title|garbage collect|dumb terminal|killer whale|trashy|bass line destroys|hate to say|kill the lights|hate speech|removed \w+ insulting|title page"
        r"|naked eye|strip the metadata|sexual reproduction|^sex: |breast cancer|cock pheasant|blue tit|explicit datatype|moderators|essay|figurative")
CALM_WORDS = "bastard garbage dumb killer trashy bass hate lights insulting title naked metadata sexual sex breast pheasant tit datatype moderators essay figurative".split()
DOMAIN = "track chapter side page edition copies label title recorded catalogue surveyor runway mastering colony ring datatype screening pheasant".split()
# (category, vote, words of which any match holds one, pattern)
VOTERS = [(c, v, frozenset(" ".join(need).split()), re.compile(p)) for c, v, need, p in [
    ("abuse", 1, INSULTS, INSULT), ("abuse", 1, YOU, _near(INSULT + "|" + SLIGHT, YOURS)), ("abuse", 1, SLIGHTS, _near(SLIGHT, INSULT, 20)),
    ("abuse", 1, ["you your word dich te"], r"\b(?:i|we)(?: will|'ll| ll| am going to| are going to|'m gonna| gonna) (?:find|kill|hurt|beat|break|hunt|get) (?:you|your)|break your|watch your back|know where you live|one more word and|ich (?:finde|bringe) dich|je vais te (?:tuer|trouver)|te voy a (?:matar|romper)"),
    ("abuse", 1, ["yourself hope rot without delete sick schade creve muerete"], r"\b(?:drown|kill|hang|hurt|shoot) yourself|hope (?:you|your)\b.{0,40}\b(?:die|dies|burn|burns|rot|suffer)|and rot\b|better (?:off )?without you|delete your account|you make me sick|schade um dich|creve\b|muerete"),
    ("abuse", 1, ["shut lost nobody crawl gueule halt callate cierra away garbage lie"], r"\bshut up\b|\bget lost\b|nobody (?:wants|likes|needs) you|crawl back|shut (?:his|her|your|its|their) (?:ugly |fat |stupid )?mouth|ferme (?:ta|vos) gueule|ta gueule|halt (?:endlich )?(?:die|deine) (?:klappe|fresse|schnauze)|callate|cierra la boca|go away and|writes this garbage|another lie from"),
    ("abuse", -1, CALM_WORDS, CALM), ("abuse", -1, DOMAIN, _any(DOMAIN[:12])),
    ("hate", 1, DEHUMAN, LOW), ("hate", 1, GROUPS, _near(WHO, LOW)),
    ("hate", 1, ["driven drive burn cleanse wipe wiped deserve hire rent schools town country land send go vertrieben ausgerottet chasse fuera expulsar serve whipped poison ruin blood finish"],
     r"driven out|drive them out|burn the homes|cleanse\b|wipe(?:d)? out|wipe them|(?:don't|do not|doesn't) deserve to (?:live|breathe)|never hire|(?:don't|do not|won't|never) rent to|out of our (?:schools|town|country|land)|send every one|go back to|vertrieben|ausgerottet|qu'on les chasse|fuera de|expulsar|made to serve|be whipped|poison everything|ruin every town|ruin our blood|by blood\b|finish what .{1,30} started"),
    ("hate", 1, DEHUMAN, r"\b(?:all|every|alle|les|the|toutes|todos)\b.{1,40}\b(?:are|sind|sont|son)\b.{0,25}" + LOW),
    ("hate", 1, ["race blood kind clean without only"], r"\b(?:their|whole|our) (?:race|blood|kind)\b|\brace is\b|finally be clean|without the .{1,30} would|the only good (?:thing|one)"),
    ("hate", 1, ["women men children decent"], r"\b(?:women|men|children) (?:are|should be|must be) (?:made|whipped|kept)|no decent .{1,30} should|keep .{1,40} children out|decent people"),
    ("hate", -1, CALM_WORDS, CALM), ("hate", -1, DOMAIN, _any(DOMAIN)),
    ("sexual", 1, EXPLICIT, SEX), ("sexual", 1, EXPLICIT, SEX + r".{0,80}?" + SEX), ("sexual", 1, EXPLICIT + ["sex"], _near(SEX + r"|\bsex\b", SOLICIT)),
    ("sexual", 1, ["sex wet please sucked came cock spread harder lick begged deeper strips naked nue positions stohnend desnuda desnudas desnudos"],
     r"\b(?:rough|group|oral|anal|wild|hot) sex\b|sex (?:tape|auf|on|with|scene)|had sex|have sex|wet girls|please you\b|sucked (?:him|her|it)|until (?:he|she) came|came (?:all )?over|hard cock|spread her|take her harder|lick every inch|begged him|pushed deeper|strips naked|got naked|se mit nue|sex tape|all positions|laut stohnend|toda la noche desnud"),
    ("sexual", -1, CALM_WORDS, CALM), ("sexual", -1, DOMAIN, _any(DOMAIN)),
]]
OF = {c: [k for k, v in enumerate(VOTERS) if v[0] == c] for c in CATEGORIES}


def _unmask(m: re.Match) -> str:
    x = m[0]
    if "*" in x and len(x.replace("*", "")) >= 2:
        p = re.compile(x.translate(SIGNS).replace("*", "[a-z]") + r"\Z")
        return next((w for w in BY_SIZE.get(len(x), ()) if p.match(w)), x.replace("*", ""))
    return x.translate(SIGNS) if any(c.isalpha() for c in x) else x


def plain(text: str) -> str:
    """Lower case, one script, signs and gaps inside words undone, drawn-out letters shortened."""
    x = text.lower()
    if not x.isascii():
        x = folded(x.translate(LOOKALIKE) if OTHER_SCRIPT.search(x) else x).replace("’", "'")
    x = DOTTED.sub(lambda m: re.sub(r"[^a-z0-9]", "", m[0]), x)
    if any(c in x for c in "@$*|"):
        x = MARKED.sub(_unmask, x)
    x = INSIDE.sub(lambda m: m[0].translate(SIGNS), x)
    return LONG.sub(r"\1", x)


def sentences(text: str | None) -> list[str]:
    """The sentences of a whole text, made plain."""
    return [p for s in SENTENCE.split(plain(mended(text))) if (p := s.strip())] if text else []


def votes(sentence: str) -> tuple[int, ...]:
    """One vote of each voter; voters against a category are asked only where one is for it."""
    has = set(WORDS.findall(sentence))
    out, wanted = [0] * len(VOTERS), set()
    for k, (c, v, need, p) in enumerate(VOTERS):
        if (v > 0 or c in wanted) and not has.isdisjoint(need) and p.search(sentence):
            out[k] = v
            wanted.add(c)
    return tuple(out)


def features(sentence: str) -> np.ndarray:
    ws = ["N" if w.isdigit() else w for w in WORDS.findall(sentence)]
    codes = {zlib.crc32(x.encode()) >> (32 - BITS) for x in ws}
    codes.update(zlib.crc32(f"{a} {b}".encode()) >> (32 - BITS) for a, b in zip(ws, ws[1:]))
    return np.array(sorted(codes), dtype=np.int64)


class LabelModel:
    """Posterior of a category from its voters by expectation maximisation over the sentences with a vote for it.

    ``gold`` patterns have a known label ``truth`` and count GOLD_WEIGHT times; they fix which class is which. A pattern
    without a vote for the category has posterior 0.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, gold: np.ndarray, truth: np.ndarray, rounds: int = 50):
        fires, known = patterns != 0, gold != 0
        counts = counts * (patterns == 1).any(axis=1)
        of_gold = GOLD_WEIGHT * ((gold == 1).any(axis=1) | (truth > 0))
        self.sign = np.where((patterns == -1).any(axis=0) | (gold == -1).any(axis=0), -1, 1)
        q = 1 / (1 + np.exp(-(1.5 * (patterns == 1).sum(axis=1) - 5.0 * (patterns == -1).sum(axis=1) - 1.5)))
        for _ in range(rounds):
            w1 = np.concatenate([counts * q, of_gold * truth])
            w0 = np.concatenate([counts * (1 - q), of_gold * (1 - truth)])
            both = np.concatenate([fires, known])
            self.prior = np.clip((w1.sum() + 5) / (w1.sum() + w0.sum() + 10), 0.02, 0.98)
            self.p1 = ((w1[:, None] * both).sum(axis=0) + np.where(self.sign > 0, 4.0, 0.2)) / (w1.sum() + 10)
            self.p1 = np.where(self.sign < 0, np.minimum(self.p1, AGAINST), self.p1)
            self.p0 = ((w0[:, None] * both).sum(axis=0) + np.where(self.sign > 0, 1.0, 4.0)) / (w0.sum() + 10)
            self.share = self._shares(both, w1, w0)
            q = self.posterior(patterns)
        self.accuracy = np.where(self.sign > 0, self.p1 / (self.p1 + self.p0), self.p0 / (self.p1 + self.p0))

    def _shares(self, fires: np.ndarray, w1: np.ndarray, w0: np.ndarray) -> np.ndarray:
        """Weight of each voter: one over what of its votes other voters repeat within the classes."""
        out = np.zeros((fires.shape[1],) * 2)
        for w, p in ((w1, self.p1), (w0, self.p0)):
            x = fires - p
            cov = (x * w[:, None]).T @ x / max(w.sum(), 1e-9)
            sd = np.sqrt(np.clip(np.diag(cov), 1e-6, None))
            out = np.maximum(out, np.clip(cov / np.outer(sd, sd), 0, 1))
        np.fill_diagonal(out, 0)
        self.correlation = out
        return 1 / (1 + out.sum(axis=1))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        fires = patterns != 0
        on, off = np.log(self.p1 / self.p0) * self.share, np.log((1 - self.p1) / (1 - self.p0)) * self.share * 0.5
        z = np.log(self.prior / (1 - self.prior)) + np.where(fires, on, off).sum(axis=1)
        return np.where((patterns == 1).any(axis=1), 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def fit_linear(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 10, rate: float = 0.4, decay: float = 1e-6) -> np.ndarray:
    """Logistic regression (Adagrad, fixed order) for each column of ``labels``; the last row holds the constants."""
    n, k = labels.shape
    w, g = np.zeros(((1 << BITS) + 1, k)), np.full(((1 << BITS) + 1, k), 1e-6)
    order = np.argsort([zlib.crc32(x.tobytes()) for x in rows], kind="stable") if n else []
    for epoch in range(epochs):
        for i in order:
            x = rows[i]
            z = w[x].sum(axis=0) + w[-1]
            step = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) * weights[i]
            one = step + decay * w[x]
            g[x] += one ** 2
            w[x] -= rate * one / np.sqrt(g[x])
            g[-1] += step ** 2
            w[-1] -= rate * step / np.sqrt(g[-1])
    return w.astype(np.float32)


def score(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[x].sum(axis=0) + w[-1], -30, 30)))


def fit(spark: SparkSession, texts: DataFrame, samples: DataFrame, bound: int = FIT) -> tuple[np.ndarray, dict[str, LabelModel]]:
    """The linear weights and the label models; ``texts`` has one column x, ``samples`` x and category."""
    n = max(1, texts.count())
    scale = min(1.0, 4.0 * bound / (5 * n)) * (1 << 32)

    def tally(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for part in parts:
            rows = []
            for x in part.x:
                for k, s in enumerate(sentences(x)):
                    v = votes(s)
                    h = zlib.crc32(s.encode())
                    seen[v] += 1
                    # drawn by occurrence, so that what is said often is among the sentences without votes
                    if any(v) or zlib.crc32(f"{k} {len(x)}".encode(), h) < scale:
                        rows.append((h, s, list(v), 0))
            yield pd.DataFrame(rows, columns=["h", "s", "v", "n"])
        yield pd.DataFrame([(0, None, list(v), k) for v, k in seen.items()], columns=["h", "s", "v", "n"])

    scratch = Scratch(spark, "votes")
    kept = scratch.write(texts.mapInPandas(tally, "h bigint, s string, v array<int>, n bigint"))
    counts = kept.where("s is null").groupBy("v").agg(F.sum("n").alias("n")).collect()
    patterns = np.array([r.v for r in counts], dtype=np.int8).reshape(-1, len(VOTERS))
    sizes = np.array([r.n for r in counts], dtype=float)
    given = [(x, r.category) for r in samples.where("x is not null and category is not null").collect() for x in [" ".join(sentences(r.x))] if x]
    gold = np.array([votes(x) for x, _ in given], dtype=np.int8).reshape(-1, len(VOTERS))
    truth = np.array([[float(g == c) for c in CATEGORIES] for _, g in given]).reshape(-1, len(CATEGORIES))
    models = {}
    for k, c in enumerate(CATEGORIES):
        uniq, at = np.unique(patterns[:, OF[c]], axis=0, return_inverse=True)
        models[c] = LabelModel(uniq, np.bincount(at.ravel(), weights=sizes, minlength=len(uniq)), gold[:, OF[c]], truth[:, k])
    some = (kept.where("s is not null").groupBy("s").agg(F.min("h").alias("h"), F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
            .withColumn("f", F.exists("v", lambda x: x > 0)))
    rows = some.where("f").orderBy("h", "s").limit(bound).collect() + some.where("not f").orderBy(F.desc("n"), "h", "s").limit(bound).collect()
    scratch.drop(kept)
    votes_of = np.array([r.v for r in rows], dtype=np.int8).reshape(-1, len(VOTERS))
    labels = np.stack([models[c].posterior(votes_of[:, OF[c]]) for c in CATEGORIES], axis=1)
    labels = np.concatenate([labels, truth])
    weights = np.concatenate([np.minimum(1 + np.log2([max(r.n, 1) for r in rows] or [1])[:len(rows)], 8), np.full(len(given), SAMPLE_WEIGHT)])
    return fit_linear([features(r.s) for r in rows] + [features(s) for s, _ in given], labels, weights), models


def scored_documents(spark: SparkSession, documents: DataFrame, samples: DataFrame, doc_id: str = "doc_id", text: str = "text",
                     sample_text: str = "sample_text", category: str = "category", bound: int = FIT) -> DataFrame:
    """(doc_id, abuse, hate, sexual): the highest score of any sentence for each category, one row a document row.

    Null and empty texts score 0, repeated rows come out as often as they went in, an empty table gives no rows, other
    columns are ignored; without samples the label model alone labels the training sentences.
    """
    docs = documents.select(F.col(doc_id).alias("d"), F.col(text).alias("x"))
    weights, _ = fit(spark, docs.where(F.length("x") > 0).select("x"), samples.select(F.col(sample_text).alias("x"), F.col(category).alias("category")), bound)
    shared = spark.sparkContext.broadcast(weights)

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for part in parts:
            best = np.zeros((len(part), len(CATEGORIES)))
            for i, x in enumerate(part.x):
                for s in sentences(x):
                    if len(f := features(s)):
                        best[i] = np.maximum(best[i], score(w, f))
            yield pd.DataFrame({"d": part.d, **{c: best[:, k] for k, c in enumerate(CATEGORIES)}})

    kind = dict(documents.dtypes)[doc_id]
    return docs.mapInPandas(judge, f"d {kind}, " + ", ".join(f"{c} double" for c in CATEGORIES)).withColumnRenamed("d", doc_id)


def flagged(scores: DataFrame, doc_id: str = "doc_id", cut: float = CUT) -> DataFrame:
    """(doc_id, category) once for each category a document is scored for."""
    pairs = F.filter(F.array(*[F.when(F.col(c) >= cut, F.lit(c)) for c in CATEGORIES]), lambda x: x.isNotNull())
    return scores.select(doc_id, F.explode(pairs).alias("category")).distinct()


def source_rates(scores: DataFrame, documents: DataFrame, source, doc_id: str = "doc_id", cut: float = CUT) -> DataFrame:
    """(source, n_docs, abuse_rate, hate_rate, sexual_rate): share of documents of each source that have a category."""
    x = scores.join(documents.select(doc_id, source.alias("source")), doc_id)
    return x.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *[F.avg((F.col(c) >= cut).cast("double")).alias(f"{c}_rate") for c in CATEGORIES])
