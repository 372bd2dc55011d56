"""Language identification by fusion of evidence (operator 6).

The text likelihood comes from hashed byte trigrams (``BUCKETS`` of them), trained on a sample of labelled documents: of
each language the share of ``TRAIN_ROWS`` in all of them, or more where that gives fewer rows than an even part of a
quarter of ``TRAIN_ROWS`` (and 50) would; ids choose by their hash, and rows are read in place. For every page, evidence is combined in log space:

* the text: its mean log likelihood per trigram, worth at most ``TEXT_WEIGHT`` trigrams;
* the declared markup language (`<html lang>`), by how often it goes with each language over all pages;
  declarations and labels are compared as whole codes, two- and three-letter ones (ISO 639) as the same;
* the host: a prior that is smoothed towards that of its domain, which is smoothed towards that of the address
  suffix, which is smoothed towards that of all pages. Their counts are sums over all pages of the text's posterior
  probabilities (grouped aggregation), without the page's own share.

Cases: a null html or one without text has equal likelihoods, so the other evidence decides; a null URL has the
empty host; ties go to the language first by name; repeated rows give repeated results; an empty table gives an
empty result; without labelled documents there is no language and the result is null; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, cut, mapped, table
from .urlfilter import host_path

BUCKETS = 1 << 15
TRAIN_ROWS = 4000
TEXT_WEIGHT = 40.0
SMOOTHING = 5.0
_HIDDEN = re.compile(rb"<(script|style)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(rb"<[^>]*>")
_LANG = re.compile(rb"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,}+)", re.I)
#: Three-letter codes (ISO 639-2 and 639-3, bibliographic ones too) by two-letter code (ISO 639-1).
_CODES = """aa aar ab abk ae ave af afr ak aka am amh an arg ar ara as asm av ava ay aym az aze ba bak be bel bg bul bi bis bm bam
bn ben bo bod bo tib br bre bs bos ca cat ce che ch cha co cos cr cre cs ces cs cze cu chu cv chv cy cym cy wel da dan de deu de ger dv div
dz dzo ee ewe el ell el gre en eng eo epo es spa et est eu eus eu baq fa fas fa per ff ful fi fin fj fij fo fao fr fra fr fre fy fry
ga gle gd gla gl glg gn grn gu guj gv glv ha hau he heb hi hin ho hmo hr hrv ht hat hu hun hy hye hy arm hz her ia ina id ind ie ile
ig ibo ii iii ik ipk io ido is isl is ice it ita iu iku ja jpn jv jav ka kat ka geo kg kon ki kik kj kua kk kaz kl kal km khm kn kan ko kor
kr kau ks kas ku kur kv kom kw cor ky kir la lat lb ltz lg lug li lim ln lin lo lao lt lit lu lub lv lav mg mlg mh mah mi mri mi mao
mk mkd mk mac ml mal mn mon mr mar ms msa ms may mt mlt my mya my bur na nau nb nob nd nde ne nep ng ndo nl nld nl dut nn nno no nor nr nbl
nv nav ny nya oc oci oj oji om orm or ori os oss pa pan pi pli pl pol ps pus pt por qu que rm roh rn run ro ron ro rum ru rus rw kin sa san
sc srd sd snd se sme sg sag si sin sk slk sk slo sl slv sm smo sn sna so som sq sqi sq alb sr srp ss ssw st sot su sun sv swe sw swa ta tam
te tel tg tgk th tha ti tir tk tuk tl tgl tn tsn to ton tr tur ts tso tt tat tw twi ty tah ug uig uk ukr ur urd uz uzb ve ven vi vie vo vol
wa wln wo wol xh xho yi yid yo yor za zha zh zho zh chi zu zul""".split()
_TWO = dict(zip(_CODES[1::2], _CODES[::2], strict=True))


def code(label: str) -> str:
    """The primary code of a label or declaration, with two letters where there is such a one."""
    c = re.split("[-_]", label.strip().lower(), maxsplit=1)[0]
    return _TWO.get(c, c)


def trigrams(text: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    return (((b[:-2] * 65599 + b[1:-1]) * 65599 + b[2:]) * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)


def visible(html: bytes) -> bytes:
    return b" ".join(_TAG.sub(b" ", _HIDDEN.sub(b" ", html)).split())


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by language and bucket)."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, np.ndarray] = {}
        for lang, t in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), strict=True):
            counts[lang] = counts.get(lang, 0) + np.bincount(trigrams(t), minlength=BUCKETS)
        at = [np.flatnonzero(c) for c in counts.values()]
        names = [x for x, k in zip(counts, at, strict=True) for _ in k]
        n = np.concatenate([c[k] for c, k in zip(counts.values(), at, strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(at).astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "k", "n"])

    rows_of = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(rows_of)
    if not langs:
        return [], np.zeros((0, BUCKETS))
    share, least = rows / sum(rows_of.values()), max(50, rows / (4 * len(langs)))
    shares = known.sparkSession.createDataFrame([(x, float(max(share, least / n))) for x, n in rows_of.items()], "lang string, share double")
    sample = known.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 40)) < F.col("share") * (1 << 40))
    table_ = np.full((len(langs), BUCKETS), 0.5)
    at = {x: i for i, x in enumerate(langs)}
    for r in mapped(sample.select("lang", "text"), fn, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows a language at most
        table_[at[r["lang"]], r["k"]] += r["n"]
    return langs, np.log(table_ / table_.sum(1, keepdims=True))


def likelihoods(text: bytes, model: np.ndarray) -> np.ndarray:
    at = trigrams(text)
    if not text.strip() or not len(at):
        return np.zeros(len(model))
    return model[:, at].mean(1) * min(len(at), TEXT_WEIGHT)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def identify(pages: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smoothing: float = SMOOTHING) -> DataFrame:
    """One row per input row: id, lang, text_lang, declared, host, confidence."""
    spark, kind = pages.sparkSession, dict(pages.dtypes)[id_col]
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select(F.col(id_col), none.alias("lang"), none.alias("text_lang"), none.alias("declared"), host_path(F.col(url_col))[0].alias("host"), F.lit(None).cast("double").alias("confidence"))
    shared = spark.sparkContext.broadcast(model)
    named = {code(x): x for x in reversed(langs)} | {x.lower(): x for x in langs}

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        ll, said = [], []
        for h in byte_texts(b.column(2)):
            h = h or b""
            m = _LANG.search(h)
            d = m[1].decode().lower() if m else "none"
            said.append("none" if m is None else named.get(d) or named.get(code(d), "other"))
            ll.append(likelihoods(visible(h), shared.value))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said), pa.array([softmax(x) for x in ll], pa.list_(pa.float64()))], ["id", "host", "declared", "p"])

    scored = mapped(pages.select(F.col(id_col).alias("id"), host_path(F.col(url_col))[0].alias("host"), F.col(html_col).alias("html")), score, f"id {kind}, host string, declared string, p array<double>")
    labels = F.split("host", r"\.")
    scored = cut(scored.withColumn("domain", F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)))).withColumn("suffix", F.element_at(labels, -1)), "language-scores")
    sums = lambda c="p": F.array(*(F.sum(F.get(c, i)) for i in range(len(langs))))
    plus = lambda a, b, f: F.zip_with(a, b, f)
    total = F.array(*(F.lit(float(x)) for x in (scored.agg(sums().alias("s")).first()["s"] or [0.0] * len(langs)) if x is not None) or [F.lit(0.0)] * len(langs))
    joint = {r["declared"]: np.array(r["s"]) for r in scored.groupBy("declared").agg(sums().alias("s")).collect()}  # languages, other and none
    every = sum(joint.values(), np.zeros(len(langs)))
    declared_given = {d: np.log((s + 0.5) / (every + 0.5 * (len(joint) + 1))) for d, s in joint.items()}
    hosts = scored.groupBy("host", "domain", "suffix").agg(sums().alias("ch"))
    domains = hosts.groupBy("domain", "suffix").agg(sums("ch").alias("cd"))
    suffixes = domains.groupBy("suffix").agg(sums("cd").alias("cs"))
    priors = hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix").select("host", "ch", "cd", "cs")
    rows = scored.join(priors, "host", "left")
    minus = lambda c: F.when(F.col(c).isNull(), F.array(*[F.lit(0.0)] * len(langs))).otherwise(plus(F.col(c), F.col("p"), lambda a, b: F.greatest(a - b, F.lit(0.0)))).alias(c)

    def fuse(b: pa.RecordBatch) -> pa.RecordBatch:
        p, ct, cs, cd, ch = (np.array(b.column(k).to_pylist(), float) for k in range(3, 8))
        prior = np.full_like(p, 1 / len(langs))
        for c in (ct, cs, cd, ch):  # from all pages down to the host
            prior = (c + smoothing * prior) / (c.sum(1, keepdims=True) + smoothing)
        z = np.log(p + 1e-300) + np.log(prior + 1e-12) + np.array([declared_given[d] for d in b.column(2).to_pylist()])
        e = np.exp(z - z.max(1, keepdims=True))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([langs[i] for i in z.argmax(1)]), pa.array([langs[i] for i in p.argmax(1)]), b.column(2), b.column(1), pa.array((e / e.sum(1, keepdims=True)).max(1))], ["id", "lang", "text_lang", "declared", "host", "confidence"])

    fused = rows.select("id", "host", "declared", "p", plus(total, F.col("p"), lambda a, b: F.greatest(a - b, F.lit(0.0))).alias("ct"), minus("cs"), minus("cd"), minus("ch"))
    return mapped(fused, fuse, f"id {kind}, lang string, text_lang string, declared string, host string, confidence double").withColumnRenamed("id", id_col)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, model = train(table(spark, sf_dir, "documents"))
    return identify(table(spark, sf_dir, "pages"), langs, model).select("page_id", "lang", "text_lang", "declared", "host")
