"""Splitting a question: the phrase that sets apart the documents behind its largest residuals becomes one of its own."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import Question, QuestionSet, keyword_answer, phrase_lift
from tidemark.operators.asof import asof
from tidemark.operators.cells import exact_quantiles

#: How many documents are looked at behind the largest residuals, and of the rest.
TOP, REST = 150, 600


def question_columns(questions: QuestionSet, prefix: str = "") -> dict[str, dict[str, str]]:
    """Column -> its question, kind, part and encoding: of each answer itself, its change and its surprise."""
    out = {}
    for q in questions.questions:
        part = "p" if q.kind in ("yes_no", "probability") else "level"
        for end, encoding in (("", "level"), ("_chg", "change"), ("_surprise", "surprise")):
            out[f"{prefix}{q.id}{end}"] = {"question": q.id, "kind": q.kind, "part": part, "encoding": encoding, "wording": q.wording, "tag": q.tag}
    return out


def column_labels(columns: Mapping[str, Mapping[str, str]], given: Mapping[str, str] | None = None) -> dict[str, str]:
    """Column -> what a card calls it: the question's wording, and how it is encoded; given names come first."""
    how = {"level": "", "change": " (change against the documents before)", "surprise": " (against the base rate)"}
    return {c: f"text: {m['wording']}{how[m['encoding']]}" for c, m in columns.items()} | dict(given or {})


def documents_behind(frame: DataFrame, docs: DataFrame, input_: str, sign: int = 1, top: int = TOP, rest: int = REST, seed: int = 0) -> DataFrame:
    """text, top: the last document before each of the rows with the largest residual (times sign) among those in which
    the input fires (its top fifth), and of a fixed draw of the others. (K17)

    frame: entity_id, decision_time, resid and the input; docs: entity_id, available_at, doc_id, text. The two limits
    are what the rule looks at."""
    d = frame.where(F.col(input_).isNotNull() & F.col("resid").isNotNull())
    edge = exact_quantiles(d, input_, [], [0.8], "__q")
    d = d.join(F.broadcast(edge)).where(F.col(input_) >= F.col("__q")[0]).select("entity_id", "decision_time", (sign * F.col("resid")).alias("__r"))  # one row
    ids = ["entity_id", "decision_time"]
    first = d.orderBy(F.col("__r").desc(), *ids).limit(top).select(*ids, F.lit(True).alias("top"))
    others = d.join(first.select(*ids), ids, "left_anti").orderBy(F.xxhash64(F.lit(seed), *ids), *ids).limit(rest).select(*ids, F.lit(False).alias("top"))
    got = asof(first.unionByName(others), "decision_time", docs, "available_at", ["entity_id"], "doc_id", ["text"])
    return got.where(F.col("text").isNotNull()).select("text", "top")


@dataclass
class PhraseSplitter:
    """(K17) Proposes new yes/no questions for inputs that stay mis-weighted, and reads them into the rows."""

    docs: DataFrame
    least_lift: float = 0.3
    most: int = 3
    avoid: Sequence[str] = ("company",)
    splits: list[dict] = field(default_factory=list)

    def propose(self, frame: DataFrame, input_: str, question: str, sign: int = 1) -> Question | None:
        """The phrase with the greatest lift that wasn't tried; none without enough lift or after `most` splits."""
        if len(self.splits) >= self.most:
            return None
        texts = documents_behind(frame, self.docs, input_, sign)
        lifts = phrase_lift(texts.withColumn("doc", F.lit(0)), "doc", "text", "top", self.least_lift)
        tried = [s["phrase"] for s in self.splits if s["input"] == input_]
        lifts = lifts.where(~F.col("gram").isin(*tried)) if tried else lifts
        for word in self.avoid:
            lifts = lifts.where(~F.col("gram").contains(word))
        best = lifts.orderBy(F.col("lift").desc(), F.col("gram").desc()).first()
        if best is None:
            return None
        q = Question(f"{question}_phrase{len(self.splits) + 1}", "yes_no", f"The text says: '{best.gram}'.", (), {"yes": r"\b" + r"\s+".join(map(re.escape, best.gram.split())) + r"\b"})
        self.splits.append({"input": input_, "phrase": best.gram, "question": q.id, "lift": best.lift})
        return q

    def read(self, rows: DataFrame, q: Question, max_age_days: float | None = None) -> DataFrame:
        """rows with a column named as the question: its answer in the last document before each decision."""
        answers = self.docs.where(F.col("text").isNotNull()).select("entity_id", "available_at", "doc_id", keyword_answer(F.col("text"), q)["value"].alias(q.id))
        return asof(rows, "decision_time", answers, "available_at", ["entity_id"], "doc_id", [q.id], max_age_days=max_age_days).drop("known_at")
