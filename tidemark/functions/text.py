"""Text to numbers without a model: keyword reader, masking, quotes, answer encodings, phrases, page text."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import let

KINDS = ("choice", "scale", "yes_no", "probability")


@dataclass(frozen=True)
class Question:
    """A typed question with keyword patterns by option (choice), level 0-4 (scale) or 'yes'."""

    id: str
    kind: str
    wording: str
    options: tuple[str, ...] = ()
    patterns: Mapping[str, str] = field(default_factory=dict)
    default: str | None = None
    tag: str = "reading"
    version: int = 1

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.id}: unknown kind {self.kind}")
        if self.kind == "choice" and len(self.options) < 2:
            raise ValueError(f"{self.id}: a choice needs options")
        if self.default is not None and self.default not in self.keys():
            raise ValueError(f"{self.id}: default {self.default} is no option")

    def keys(self) -> tuple[str, ...]:
        return {"choice": self.options, "scale": tuple("01234")}.get(self.kind, ("yes",))


@dataclass(frozen=True)
class QuestionSet:
    """(X1) Versioned questions of one document type."""

    name: str
    doc_types: tuple[str, ...]
    questions: tuple[Question, ...]

    def __post_init__(self):
        ids = [q.id for q in self.questions]
        if len(ids) != len(set(ids)):
            raise ValueError(f"{self.name}: repeated question")

    def with_question(self, q: Question) -> QuestionSet:
        """Added, or changed with the next version."""
        old = {x.id: x for x in self.questions}
        q = replace(q, version=old[q.id].version + 1) if q.id in old else q
        return replace(self, questions=tuple(q if x.id == q.id else x for x in self.questions) + (() if q.id in old else (q,)))

    def without(self, id_: str) -> QuestionSet:
        return replace(self, questions=tuple(q for q in self.questions if q.id != id_))

    def fingerprint(self) -> str:
        body = [[q.id, q.kind, q.version, q.wording, list(q.options), dict(q.patterns), q.default] for q in self.questions]
        return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()

    @classmethod
    def load(cls, path: str) -> QuestionSet:
        import yaml

        with open(path) as f:
            y = yaml.safe_load(f)
        qs = tuple(Question(q["id"], q["kind"], q["wording"], tuple(q.get("options", ())), q.get("patterns", {}), q.get("default"), q.get("tag", "reading"), q.get("version", 1)) for q in y["questions"])
        return cls(y["name"], tuple(y["doc_types"]), qs)


class Reader(Protocol):
    """Anything that answers a question set over documents as columns; paid readers plug in here."""

    def answers(self, docs: DataFrame, text: str, questions: QuestionSet) -> DataFrame: ...


def _found(text: Column, pattern: str) -> Column:
    """struct(n, at, e): number of matches, place and text of the first; each pattern runs once over a text without any."""
    p = f"(?i){pattern}"
    at = lambda m: F.when(F.size(m) > 0, F.regexp_instr(text, F.lit(p))).otherwise(0)
    return let(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: F.struct((-F.size(m)).alias("n"), at(m).alias("at"), F.get(m, F.lit(0)).alias("e")))


def keyword_answer(text: Column, q: Question) -> Column:
    """struct(probs: map, value: double, evidence: string) by counting patterns; no UDF.

    yes/no: 0.9 with a match, else 0.1. Choice and scale: the key with most matches has 0.9, on a tie the earliest;
    without a match the default has 0.6; without default a scale stands at 2 and a choice is uniform. The others share the rest. Null
    text reads as empty."""
    t = F.coalesce(text, F.lit(""))
    if q.kind in ("yes_no", "probability"):

        def yes(hit: Column) -> Column:
            p = F.when(hit != "", 0.9).otherwise(0.1)
            return F.struct(F.create_map(F.lit("yes"), p).alias("probs"), p.alias("value"), F.nullif(hit, F.lit("")).alias("evidence"))

        return let(F.regexp_extract(t, f"(?i){q.patterns['yes']}", 0), yes)
    keys = q.keys()
    fallback = q.default or ("2" if q.kind == "scale" else None)

    def answer(best: Column) -> Column:
        found = best["n"] < 0
        top = F.when(found, best["k"]).otherwise(F.lit(fallback))
        mass = F.when(found, F.lit(0.9)).otherwise(F.lit(0.6 if fallback else 1 / len(keys)))
        prob = lambda k: F.when(top == k, mass).otherwise((1 - mass) / (len(keys) - 1)) if fallback else F.when(found & (top == k), mass).when(found, (1 - mass) / (len(keys) - 1)).otherwise(1 / len(keys))
        probs = F.create_map(*[x for k in keys for x in (F.lit(k), prob(k))])
        value = sum(([F.lit(float(k)) * prob(k) for k in keys]), F.lit(0.0)) if q.kind == "scale" else F.lit(None).cast("double")
        return F.struct(probs.alias("probs"), value.alias("value"), F.when(found, best["e"]).alias("evidence"))

    seen = lambda i, k: let(_found(t, q.patterns[k]), lambda f: F.struct(f["n"].alias("n"), f["at"].alias("at"), F.lit(i).alias("i"), F.lit(k).alias("k"), f["e"].alias("e")))
    return let(F.array_min(F.array(*[seen(i, k) for i, k in enumerate(keys) if k in q.patterns])), answer)


class KeywordReader:
    """(X4)"""

    name = "keyword-1"

    def answers(self, docs: DataFrame, text: str, questions: QuestionSet) -> DataFrame:
        return docs.withColumns({q.id: keyword_answer(F.col(text), q) for q in questions.questions})


class ReplayReader:
    """Stored answers by document and entity, else by document."""

    def __init__(self, stored: DataFrame, columns: Sequence[str]):
        self.stored, self.columns = stored, list(columns)

    def join(self, docs: DataFrame) -> DataFrame:
        own = self.stored.where("entity_id is not null").select("doc_id", "entity_id", F.struct(*self.columns).alias("__a"))
        any_ = self.stored.where("entity_id is null").select("doc_id", F.struct(*self.columns).alias("__b"))
        d = docs.join(own, ["doc_id", "entity_id"], "left").join(any_, "doc_id", "left").withColumn("__c", F.coalesce("__a", "__b"))
        return d.select(*docs.columns, *[F.col(f"__c.{c}").alias(c) for c in self.columns])


def answer_key(reader: str, q: Question, text: Column) -> Column:
    """Cache key: any change of reader, question, version, wording or text is another key."""
    return F.sha2(F.concat(*[F.concat(F.lit(x), F.lit("\0")) for x in (reader, f"{q.id}@{q.version}", q.wording)], F.coalesce(text, F.lit("")), F.lit("\0")), 256)


def unread(docs: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Documents whose key isn't in the cache: the reading service's work list."""
    return docs.join(cache.select(key).distinct(), key, "left_anti")


def quote_ok(quote: Column, text: Column) -> Column:
    """Whether the quote is in the text, up to case and white space."""
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r\f]+", " "))
    return flat(text).contains(flat(quote))


def encode_scale(probs: Column) -> Column:
    """struct(mean, sd) of the normalised distribution over numeric levels."""
    total = F.aggregate(F.map_values(probs), F.lit(0.0), lambda a, x: a + x)
    mean = F.aggregate(F.map_entries(probs), F.lit(0.0), lambda a, e: a + e["key"].cast("double") * e["value"]) / F.nullif(total, F.lit(0.0))
    sq = F.aggregate(F.map_entries(probs), F.lit(0.0), lambda a, e: a + e["key"].cast("double") * e["key"].cast("double") * e["value"]) / F.nullif(total, F.lit(0.0))
    return F.struct(mean.alias("mean"), F.sqrt(F.greatest(sq - mean * mean, F.lit(0.0))).alias("sd"))


def to_observations(wide: DataFrame, ids: Sequence[str], columns: Sequence[str], seq: str) -> DataFrame:
    """ids, seq, feature, value; a document without an answer emits nothing."""
    return wide.unpivot([*ids, seq], list(columns), "feature", "value").where(F.col("value").isNotNull())


def _edge(word: Column, ignore_case: bool) -> Column:
    return F.concat(F.lit("(?i)" if ignore_case else ""), F.lit("(^|[^A-Za-z0-9])"), word, F.lit("($|[^A-Za-z0-9])"))


def mask(text: Column, name: Column, code: Column, common: Sequence[str] = ()) -> Column:
    """text with the company's full name, its code (case counts) and its first word replaced.

    A first word that is a dictionary word is masked only where it is capitalised. Name and code hold letters, digits
    and blanks in their first word; null leaves the text as it is."""
    first = F.regexp_extract(name, r"^([A-Za-z0-9]+)", 1)
    t = F.when(name.isNotNull(), F.replace(text, name, F.lit("COMPANY"))).otherwise(text)
    t = F.when(code.isNotNull() & code.rlike("^[A-Za-z0-9]+$"), F.regexp_replace(t, _edge(code, False), F.lit("$1TICKER$2"))).otherwise(t)
    plain = F.regexp_replace(t, _edge(first, True), F.lit("$1COMPANY$2"))
    capital = F.regexp_replace(t, _edge(F.initcap(first), False), F.lit("$1COMPANY$2"))
    masked = F.when(F.lower(first).isin(*common), capital).otherwise(plain) if common else plain
    return F.when(F.coalesce(F.length(first), F.lit(0)) >= 4, masked).otherwise(t)


def alternative_mask(text: Column, token: str = "THE FIRM") -> Column:
    """(X3)"""
    return F.replace(text, F.lit("COMPANY"), F.lit(token))


def residual_names(text: Column, name: Column) -> Column:
    """Words of the name of four letters or more that the text still holds."""
    words = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    return F.filter(F.array_distinct(words), lambda w: F.lower(text).contains(w))


def sentences(text: Column) -> Column:
    """(X13)"""
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\n\r]+", "$1\u0001"), "\u0001")


def grams_of(text: Column) -> Column:
    """Every three words in a row within a sentence, each once."""
    words = F.transform(sentences(F.lower(text)), lambda s: F.regexp_extract_all(s, F.lit("[a-z][a-z-]*"), F.lit(0)))
    some = F.filter(words, lambda w: F.size(w) >= 3)
    return F.array_distinct(F.flatten(F.transform(some, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.concat_ws(" ", F.slice(w, i, 3))))))


def trigrams(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """id, gram: the trigrams of each row, once a row."""
    return docs.select(id_, F.explode(grams_of(F.col(text))).alias("gram"))


def phrase_lift(docs: DataFrame, id_: str, text: str, target: str, least: float) -> DataFrame:
    """gram, inside, outside, lift: share of target documents less share of others; every row is a document.

    One pass and one shuffle: the totals are counted under a gram of their own, the empty one."""
    g = docs.select(target, F.explode(F.concat(F.coalesce(grams_of(F.col(text)), F.array().cast("array<string>")), F.array(F.lit("")))).alias("gram"))
    g = g.groupBy("gram").agg(F.count(F.when(F.col(target), 1)).alias("i"), F.count(F.when(~F.col(target), 1)).alias("o"))
    n = g.where("gram = ''").select(F.col("i").alias("__i"), F.col("o").alias("__o"))
    g = g.where("gram <> ''").join(F.broadcast(n)).select("gram", (F.col("i") / F.nullif("__i", F.lit(0))).alias("inside"), (F.col("o") / F.nullif("__o", F.lit(0))).alias("outside"))  # one row
    return g.withColumn("lift", F.coalesce("inside", F.lit(0.0)) - F.coalesce("outside", F.lit(0.0))).where(F.col("lift") > least)


def page_text(html: Column, cap: int | None = None) -> Column:
    """Text of a page: scripts, tags and entities out, white space single, signature block cut; at most cap characters if given."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    t = F.trim(F.regexp_replace(t, r"[ \t\n\r\f]+", " "))
    t = F.trim(F.regexp_replace(t, r"(?s)SIGNATURES? .*$", ""))
    return t if cap is None else F.substring(t, 1, cap)


def section_cut(text: Column) -> Column:
    """The text from its first numbered item on ("Item 2.02"), so without the cover of a filing; whole without any."""
    at = F.regexp_instr(text, F.lit(r"(?i)\bitem\s+\d+\.\d+"))
    return F.when(at > 0, F.substr(text, at)).otherwise(text)


def expected_previous(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], k: int, least: int) -> DataFrame:
    """df with <x>_chg: against the mean of the k answers before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-k, -1)
    return df.withColumn(f"{x}_chg", F.col(x) - F.when(F.count(x).over(w) >= least, F.avg(x).over(w)))
