"""The glossary: terms of questions, the phrases that they are looked up by, and the weighted terms of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions import text as T

#: Terms of questions and the phrases that they are looked up by.
GLOSSARY = (
    ("모니터링 계획", "monitoring plan"), ("모니터링", "monitoring"), ("배출권", "allowances"), ("제출 의무", "surrender obligation"), ("제출", "submit surrender"),
    ("선사", "shipping company"), ("해운회사", "shipping company"), ("선박회사", "shipping company"), ("화주", "cargo owner"), ("항해", "voyage"), ("기항", "port of call"),
    ("항만", "port of call"), ("항구", "port of call"), ("배출량", "emissions"), ("온실가스", "greenhouse gas"), ("검증인", "verifier"), ("검증기관", "verifier"),
    ("검증", "verification"), ("보고 기간", "reporting period"), ("보고서", "report"), ("보고", "reporting"), ("선박", "ship"), ("총톤수", "gross tonnage"), ("벌금", "penalty"),
    ("과태료", "penalty"), ("면제", "exemption"), ("적용 범위", "scope"), ("적용", "scope application"), ("기한", "deadline"), ("언제까지", "deadline by"), ("퍼센트", "percentage"),
    ("역외", "outside"), ("회원국", "member state"), ("의무", "obligation"), ("준수", "compliance"), ("연료", "fuel"), ("탄소", "carbon"), ("에너지 집약도", "energy intensity"),
    ("집약도", "intensity"), ("정박", "at berth"), ("접안", "at berth"), ("육상전원", "onshore power supply ops"), ("신고", "declaration"), ("수입업자", "importer"),
    ("무상할당", "free allocation"), ("무료할당", "free allocation"), ("잉여", "surplus"), ("벌칙", "penalty"), ("등록부", "registry"), ("인증서", "certificate"),
)
GLOSSARY_WEIGHT, TRANSLATION_WEIGHT = 1.0, 0.1


def glossary_terms(question: Column) -> Column:
    """Tokens of the phrases of all terms that a question contains, then its own ASCII tokens, once each. The phrases are constants, tokenised here."""
    held = F.lit(None).cast("array<string>")
    phrases = F.array(*[F.when(F.contains(question, F.lit(ko)), F.array(*map(F.lit, T.tokens_of(en)))).otherwise(held) for ko, en in GLOSSARY])
    own = F.filter(T.tokenize(question), lambda t: t.rlike("^[a-z0-9]+$"))
    return F.array_distinct(F.concat(F.flatten(F.array_compact(phrases)), own))


def weighted_terms(question: Column, translated: Column) -> Column:
    """(term, weight): glossary terms at 1, those only in the translation at 0.1. The glossary terms are bound once and used twice."""
    def weigh(terms: Column, w: float) -> Column:
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(w).alias("weight")))

    more = F.array_distinct(T.tokenize(translated))
    both = F.transform(F.array(F.struct(glossary_terms(question).alias("sure"), more.alias("more"))), lambda x: F.concat(weigh(x["sure"], GLOSSARY_WEIGHT), weigh(F.array_except(x["more"], x["sure"]), TRANSLATION_WEIGHT)))
    return F.get(both, F.lit(0))


#: Characters of a term by which it is looked up; shorter ones by all they have.
HEAD = 4
#: Bytes of a glossary that is sent to every task; a larger one is joined by a shuffle.
MAX_BROADCAST = 64 << 20


def glossary_table(spark: SparkSession) -> DataFrame:
    """(ko, en): the fixed glossary as rows."""
    return spark.createDataFrame(list(GLOSSARY), "ko string, en string")


#: Code points that are told apart together, and how many ranges of them a pattern holds, when places are looked for at which a term may begin.
BLOCK, MOST_RANGES = 16, 64


def _beginnings(blocks: list[int]) -> str:
    """A class of characters that holds all of these blocks of code points; where they make too many ranges, those nearest to each other become one."""
    ends = [[b, b] for b in sorted(blocks)]
    gaps = sorted((y[0] - x[1], i) for i, (x, y) in enumerate(zip(ends, ends[1:], strict=False)))
    joined = {i for gap, i in gaps if gap == 1} | {i for _, i in gaps[: max(0, len(ends) - MOST_RANGES)]}
    ranges = []
    for i, (low, high) in enumerate(ends):
        if i and i - 1 in joined:
            ranges[-1][1] = high
        else:
            ranges.append([low, high])
    return "[" + "".join(rf"\x{{{low * BLOCK:x}}}-\x{{{min(high * BLOCK + BLOCK - 1, 0x10FFFF):x}}}" for low, high in ranges) + "]"


def contained(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, ko, en) of every term (ko, en) that a question (query_id, question) contains, once each; for glossaries of any size.

    From each place of a question at which some term may begin, by the block of its character, its next HEAD characters are taken, once each; terms are met by their own first ones, and what is
    left of them is looked for. So a question meets the terms that begin as a part of it does, not the whole glossary, and a place where none begins makes no row.
    """
    known = terms.filter(F.length("ko") > 0).select("ko", "en", F.substring("ko", 1, HEAD).alias("head"))
    # One row: bytes of the glossary, and blocks of code points, of which Unicode has 69,632.
    n_bytes, blocks = known.agg(F.coalesce(F.sum(F.octet_length("ko") + F.octet_length(F.coalesce("en", F.lit(""))) + 40), F.lit(0)), F.collect_set(F.floor(F.ascii("ko") / BLOCK).cast("int"))).first()
    few = n_bytes <= MAX_BROADCAST
    asked = questions.filter(F.length("question") > 0).select("query_id", "question")
    if not blocks:
        return asked.crossJoin(known).select("query_id", "ko", "en").limit(0)
    places = F.array_distinct(F.regexp_extract_all("question", F.lit(f"(?s)(?=({_beginnings(blocks)}.{{0,{HEAD - 1}}}))"), 1))
    heads = F.array_distinct(F.flatten(F.transform(places, lambda p: F.transform(F.sequence(F.lit(1), F.length(p)), lambda n: F.substr(p, F.lit(1), n)))))
    kept = ["query_id", "question"] if few else ["query_id"]
    cut = asked.select(*kept, F.explode(heads).alias("head"))
    met = cut.join(F.broadcast(known) if few else known, "head")
    if not few:  # the question isn't shuffled with each of its heads
        met = met.select("query_id", "ko", "en").distinct().join(asked, "query_id")
    return met.filter(F.contains("question", F.col("ko"))).select("query_id", "ko", "en").distinct()


def weighted_term_rows(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, term, weight) of questions (query_id, question, translated) by a glossary table: what ``weighted_terms`` gives for the fixed one."""
    phrases = contained(questions, terms).select("query_id", F.explode(F.array_distinct(T.tokenize(F.col("en")))).alias("term"), F.lit(GLOSSARY_WEIGHT).alias("weight"))
    weigh = lambda terms, w: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(w).alias("weight")))
    own = F.array_distinct(F.filter(T.tokenize(F.col("question")), lambda t: t.rlike("^[a-z0-9]+$")))
    more = F.array_distinct(T.tokenize(F.col("translated")))
    both = F.concat(weigh(own, GLOSSARY_WEIGHT), weigh(more, TRANSLATION_WEIGHT))
    said = questions.select("query_id", F.explode(both).alias("t")).select("query_id", "t.term", "t.weight")
    # A term that is sure weighs as that, wherever else it occurs.
    return phrases.unionByName(said).groupBy("query_id", "term").agg(F.max("weight").alias("weight"))
