"""The text path composed: full masking of names, a reading service over a cache, and a text source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import QuestionSet, answer_key, expected_previous, keyword_answer, to_observations
from tidemark.operators.windows import surprise
from tidemark.plans.governance import Ledger, OverBudget, Spend

TOKEN = "COMPANY_A"
# Legal forms that follow a name, common first words of names, and what gives a company away besides its name.
SUFFIXES = r"\b(?:INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|LTD|PLC|LLC|HOLDINGS|GROUP|THE|N\.?V|S\.?A)\b\.?"
GENERIC = (
    "AMERICA", "AMERICAN", "NATIONAL", "FIRST", "UNITED", "GENERAL", "INTERNATIONAL", "GLOBAL", "FEDERAL", "NATURAL", "PACIFIC", "ATLANTIC", "SOUTHERN", "NORTHERN", "WESTERN", "EASTERN",
    "CENTRAL", "CAPITAL", "STANDARD", "UNIVERSAL", "CONTINENTAL", "SECURITY", "COMMUNITY", "PEOPLES", "CITIZENS", "HOME", "HEALTH", "ENERGY", "FINANCIAL", "MEDICAL", "PRISON",
    "CORPORATE", "FOODS", "REHABILITATION", "SELECT", "MAIN",
)
BRAND = r"\b[A-Z][A-Za-z0-9\-]{2,}(?=\s*(?:®|™|\(R\)|\(TM\)))"
CODE = r"\b(?!(?:FY|CY|Q|H|EX|COVID|ISO|SARS|NCT)-?\d)[A-Z]{1,5}-?\d{2,6}[A-Z]?\b"
TRIAL = r"(?=[^.]{0,60}\b(?:trial|study|studies)\b)"
KEEP = ("FDA", "EMA", "NDA", "BLA", "SEC", "CEO", "CFO", "COO", "USA", "GAAP", "EPS", "EBITDA", "PDUFA", "IND", "CRL", "NASDAQ", "NYSE", "ATM", "PIPE", "LLC", "INC", "LP", "ET", "PST", "EST", "QOQ", "YOY")


def core_words(name: Column) -> Column:
    """Words of a name in upper case, without commas and legal forms."""
    plain = F.regexp_replace(F.upper(F.regexp_replace(name, ",", " ")), SUFFIXES, " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def _quoted(word: Column) -> Column:
    return F.regexp_replace(word, r"([^A-Za-z0-9])", r"\\$1")


def mask_company(text: Column, names: Column, ticker: Column, dictionary: Sequence[str] = (), stems: str | None = None, extras: Sequence[str] = ("brands", "codes", "trials")) -> Column:
    """text without a trace of the company.

    In order: its full names, the longest first, with the legal forms after them; its ticker, as written; the first
    word of each name, in any case if the dictionary lacks it (four letters), else only capitalised (five letters, and
    not GENERIC); without a dictionary every first word only capitalised. Then brands with their sign, products named
    by a stem, code names and acronyms of trials, but for those in KEEP. names is an array; null names or ticker are
    skipped; names of under three letters are left."""
    clean = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isNotNull())
    longest = F.transform(F.array_sort(F.transform(clean, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n")))), lambda s: s["n"])
    cores = F.filter(F.transform(longest, lambda n: core_words(n)), lambda w: F.length(F.array_join(w, " ")) >= 3)
    pattern = lambda w: F.concat(F.lit("(?i)(?<![A-Za-z])"), F.array_join(F.transform(w, _quoted), r"\s+"), F.lit(rf"(\s*{SUFFIXES})*"))
    t = F.aggregate(cores, text, lambda t, w: F.regexp_replace(t, pattern(w), F.lit(TOKEN)))
    code = F.concat(F.lit("(?<![A-Za-z])"), _quoted(ticker), F.lit("(?![A-Za-z])"))
    t = F.when(ticker.isNotNull() & (ticker != ""), F.regexp_replace(t, code, F.lit(TOKEN))).otherwise(t)
    first = F.array_distinct(F.filter(F.transform(F.filter(F.transform(longest, lambda n: core_words(n)), lambda w: F.size(w) > 0), lambda w: w[0]), lambda w: w.rlike("^[A-Za-z]+$")))
    lower = F.array(*[F.lit(w.lower()) for w in dictionary]) if dictionary else F.array().cast("array<string>")
    known = lambda w: F.array_contains(lower, F.lower(w))
    own = lambda w: F.lit(bool(dictionary)) & (F.length(w) >= 4) & ~known(w)
    proper = lambda w: ~own(w) & (F.length(w) >= 5) & ~w.isin(*GENERIC) & (F.lit(not dictionary) | known(w))
    edge = lambda body, flag="": F.concat(F.lit(f"{flag}(?<![A-Za-z])(?:"), body, F.lit(")(?![A-Za-z])"))
    t = F.aggregate(F.filter(first, own), t, lambda t, w: F.regexp_replace(t, edge(w, "(?i)"), F.lit(TOKEN)))
    t = F.aggregate(F.filter(first, proper), t, lambda t, w: F.regexp_replace(t, edge(F.concat(F.initcap(F.lower(w)), F.lit("|"), w)), F.lit(TOKEN)))
    keep = "|".join((*KEEP, TOKEN))
    if "brands" in extras:
        t = F.regexp_replace(t, BRAND, "PRODUCT_X")
    if stems:
        t = F.regexp_replace(t, rf"(?i)\b[A-Za-z]{{3,}}(?:{stems})\b", "DRUG_X")
    if "codes" in extras:
        t = F.regexp_replace(t, CODE, "DRUG_X")
    if "trials" in extras:
        t = F.regexp_replace(t, rf"\b(?!(?:{keep})\b)[A-Z][A-Z0-9\-]{{2,11}}\b{TRIAL}", "TRIAL_X")
    return t


@dataclass
class ReadingService:
    """Answers for every (document, entity) from a cache of parquet files, which it fills by its reader.

    A paid reader (usd_per_char above 0) needs a ledger and a step: the whole is estimated first and refused if it
    exceeds what is left, then read in parts of `chunk` documents, each guarded and recorded. answers(docs) returns the
    columns of the question set; a text is read once however many rows share it."""

    questions: Mapping[str, QuestionSet]
    folder: str
    name: str = "keyword-1"
    usd_per_char: float = 0.0
    ledger: Ledger | None = None
    step: str = ""
    chunk: int = 10_000

    def jobs(self, docs: DataFrame) -> DataFrame:
        """docs with question and key: a row a document and question of its type; documents of other types have none."""
        parts = []
        for kind, qs in self.questions.items():
            d = docs.where(F.col("doc_type") == kind)
            parts += [d.withColumn("question", F.lit(q.id)).withColumn("key", answer_key(self.name, q, F.col("text"))) for q in qs.questions]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def cache(self, docs: DataFrame) -> DataFrame:
        try:
            return docs.sparkSession.read.schema("key string, value double").parquet(self.folder)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return docs.sparkSession.createDataFrame([], "key string, value double")

    def todo(self, docs: DataFrame) -> DataFrame:
        """Of the jobs that aren't in the cache one of each key."""
        return self.jobs(docs).join(self.cache(docs), "key", "left_anti").dropDuplicates(["key"])

    def estimate(self, docs: DataFrame) -> dict[str, float]:
        r = self.todo(docs).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
        return {"answers": r.n, "usd": r.c * self.usd_per_char}

    def _read(self, part: DataFrame) -> DataFrame:
        value = F.lit(None).cast("double")
        for qs in self.questions.values():
            for q in qs.questions:
                value = F.when(F.col("question") == q.id, keyword_answer(F.col("text"), q)["value"]).otherwise(value)
        return part.select("key", value.alias("value"))

    def answers(self, docs: DataFrame) -> DataFrame:
        """doc_id, entity_id, question, value of every document that has questions."""
        todo = self.todo(docs)
        if self.usd_per_char > 0:
            if self.ledger is None or not self.step:
                raise OverBudget("a paid reader needs a ledger and a step")
            whole = self.estimate(docs)
            self.ledger.guard(self.step, self.name, whole["usd"])
            parts = max(1, -(-int(whole["answers"]) // self.chunk))
            for k in range(parts):
                part = todo.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k)
                chars = int(part.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0])
                self.ledger.guard(self.step, self.name, chars * self.usd_per_char)
                self._read(part).write.mode("append").parquet(self.folder)
                self.ledger.record(Spend(step=self.step, provider=self.name, model=self.name, units_in=chars, usd=chars * self.usd_per_char))
        else:
            self._read(todo).write.mode("append").parquet(self.folder)
        have = self.cache(docs).dropDuplicates(["key"])
        return self.jobs(docs).join(have, "key").select("doc_id", "entity_id", "question", "value")


def text_source(docs: DataFrame, questions: QuestionSet, levels: Sequence[Sequence[str]], strength: float = 20.0, k: int = 4, least: int = 2) -> DataFrame:
    """entity_id, available_at, doc_id, feature, value: each answer, its change against the k before, and its surprise.

    levels are the keys from which expectations are shrunk. Documents without a stamp emit nothing."""
    wide = docs.where(F.col("available_at").isNotNull())
    for q in questions.questions:
        wide = wide.withColumn(q.id, keyword_answer(F.col("text"), q)["value"])
    names = [q.id for q in questions.questions]
    for n in names:
        wide = expected_previous(wide, n, ["entity_id", "doc_type"], ["available_at", "doc_id"], k, least)
        wide = surprise(wide, n, "available_at", levels, strength).withColumnRenamed("surprise", f"{n}_surprise")
    return to_observations(wide, ["entity_id", "available_at"], [c for n in names for c in (n, f"{n}_chg", f"{n}_surprise")], "doc_id")
