"""The registered text queries, and the pipeline, against plain Python over whole small tables."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from densegraph.llm import quality_rules, queries, secrets, toxicity

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "a", "ß é 😀 é", "word " * 300, "A\x1cb\x85c\xa0d", "x\n\nx\nX !!! ###", "password = hunter2 and AKIA" + "Z" * 20 + "api_key: token: abcdefgh", "Secret='token=aaaaaa' 0123456789abcdef01234567xyz"]
TABLE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def random_tokens(n):
    rng = np.random.default_rng(11)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    return ["".join(rng.choice(letters, 40)) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The small tables, with odd texts, repeated rows, null ids and tokens added to the documents."""
    path = tmp_path_factory.mktemp("tables")
    rows = pq.read_table(f"{SMALL}/documents.parquet").select(TABLE.names).to_pylist()
    new = [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id here"), (1003, "a")]
    new += [(2000 + i, f"the key {t} of item version{i}release2024final{i}notes") for i, t in enumerate(random_tokens(40))]
    rows += [{"doc_id": i, "text": t, "lang": None, "source": None, "n_chars": None} for i, t in new]
    pq.write_table(pa.Table.from_pylist(rows, TABLE), path / "documents.parquet")
    for name in ("benchmark", "labels", "pages"):
        pq.write_table(pq.read_table(f"{SMALL}/{name}.parquet"), path / f"{name}.parquet")
    return str(path)


def documents(folder):
    return pq.read_table(f"{folder}/documents.parquet").to_pylist()


def run(spark, folder, name):
    return [r.asDict() for r in queries.queries()[name](spark, folder).collect()]


def same(got, want, *fields):
    key = lambda r: tuple((r[f] is None, str(r[f])) for f in fields)
    assert sorted(map(key, got)) == sorted(map(key, want))


def base_spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(secrets.BASE_KINDS):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m.group(group)) >= least]
    return sorted(found)


def p_value(token, alphabet):
    n, size = len(token), len(alphabet)
    normal = lambda x, df: (max(x, 0) / df) ** (1 / 3) / math.sqrt(2 / (9 * df)) - (1 - 2 / (9 * df)) / math.sqrt(2 / (9 * df))
    even = max(normal(sum(c * c for c in Counter(token).values()) * size / n - n, size - 1), 0)
    codes = [alphabet.index(c) for c in token]
    high = [2 * c >= size for c in codes]
    k, runs = sum(high), 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    hl = 2 * k * (n - k)
    runs_z = 9.0 if hl == 0 else (runs - 1 - hl / n) / math.sqrt(max(hl * (hl - n) / (n * n * (n - 1)), 1e-9))
    mid = (size - 1) / 2
    serial = sum((a - mid) * (b - mid) for a, b in zip(codes, codes[1:], strict=False)) / ((size * size - 1) / 12) / math.sqrt(n - 1)
    z = max(-30, min(30, normal(even * even + runs_z * runs_z + serial * serial, 3)))
    return 1 / (1 + math.exp(1.5976 * z + 0.07056 * z**3))


def tokens(text):
    """(start, end, stratum, p) of the tokens that are tested."""
    base, out = base_spans(text), []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", text or ""):
        t = m.group()
        if any(s < m.end() and m.start() < e for s, _, e, _ in base):
            continue
        name, alphabet = next((n, a) for n, p, a in secrets.ENCODINGS if re.search(p, t))
        if len(t) >= secrets.LEAST_LENGTHS.get(name, 16) and (name in secrets.LEAST_LENGTHS or re.search("[0-9]", t) and re.search("[A-Za-z]", t)):
            out.append((m.start(), m.end(), f"{name}:{math.floor(4 * math.log2(len(t)))}", p_value(t, alphabet)))
    return out


def every_span(texts):
    found, histogram = [tokens(t) for t in texts], {}
    for x in (x for f in found for x in f):
        bins = histogram.setdefault(x[2], Counter())
        bins[min(int(x[3] * secrets.BINS), secrets.BINS - 1)] += 1
    least = secrets.thresholds(histogram, 0.05).least
    return [sorted(base_spans(t) + [(s, len(secrets.BASE_KINDS), e, "random") for s, e, k, p in f if p >= least.get(k, 2)]) for t, f in zip(texts, found, strict=True)]


def listed(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)


def test_op2(spark, folder):
    docs, want = documents(folder), []
    for d, spans in zip(docs, every_span([d["text"] for d in docs]), strict=True):
        base = base_spans(d["text"])
        n = Counter(x[3] for x in base)
        want.append({"doc_id": d["doc_id"], "n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"], "base_sha256": hashlib.sha256(listed(base).encode()).hexdigest(), "spans": listed(spans)})
    got = run(spark, folder, "op2_secret_scan")
    same(got, want, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    found = sum("random" in r["spans"] for r in got if (r["doc_id"] or 0) >= 2000)
    assert found >= 35 and sum("random" in r["spans"] for r in got) == found  # the planted tokens and no others


def test_secret_strata_are_judged_by_one_rule():
    """A lone random token counts as a secret whether its stratum has one token or two hundred; a tail of ordinary ones doesn't."""
    least = lambda bins: secrets.thresholds({"x": bins}, 0.05).least.get("x", 2)
    assert least({40: 1}) <= 0.05 and least(dict.fromkeys(range(100), 2)) <= 0.05
    assert least({0: 100_000, 40: 1}) <= 0.05
    assert least({b: 200_000 // (b + 1) ** 2 for b in range(100)}) > 0.2


def test_op3_and_op8(spark, folder):
    docs = documents(folder)
    lib, piece = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counts = [len(lib.encode(d["text"] or "", add_special_tokens=False).ids) for d in docs]
    same(run(spark, folder, "op3_token_counts"), [{"doc_id": d["doc_id"], "n_bytes": len((d["text"] or "").encode()), "n_tokens": n, "over_limit": n > 2048} for d, n in zip(docs, counts, strict=True)], "doc_id", "n_bytes", "n_tokens", "over_limit")
    same(run(spark, folder, "op8_sentencepiece"), [{"doc_id": d["doc_id"], "ids": piece.encode(d["text"] or ""), "round_trip": True} for d in docs], "doc_id", "ids", "round_trip")


def judged(texts):
    """Figures of the quality rules, and the posterior of each text by expectation-maximisation over the texts themselves."""
    rows, votes = [], []
    vote = lambda good, bad: -1 if bad else 1 if good else 0
    for t in texts:
        w, t = words(t), t or ""
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        count, cover = Counter(windows), set()
        for i, x in enumerate(windows):
            cover |= set(range(i, i + 8)) if count[x] > 1 else set()
        lines = [x for x in t.split("\n") if words(x)]
        r = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover)}
        r["base_failed"] = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        rows.append(r)
        n, chars = max(len(w), 1), max(r["word_chars"], 1)
        stops, marks, upper = (len(re.findall(p, t)) for p in (r"[.!?]", r"[!?]", "[A-ZÄÖÜÉÈÀÇÊÑÓÍ]"))
        own = len(set(w) & set(quality_rules.FUNCTION_WORDS))
        votes.append((
            vote(n >= 50, n < 20), vote(3 * n <= chars <= 9 * n, chars < 2 * n or chars > 15 * n), vote(r["n_symbols"] / n < 0.05, r["n_symbols"] / n > 0.3), vote(len(cover) / n < 0.1, len(cover) / n > 0.3),
            vote(not r["n_dup_lines"], 3 * r["n_dup_lines"] > len(lines)), vote(upper / chars < 0.15, upper / chars > 0.4), vote(marks / n < 0.1, marks / n > 0.5), vote(own >= 2, own == 0 and n >= 50),
            vote(0.02 <= stops / n <= 0.5, stops == 0 and n >= 50),
        ))
    x = np.stack([np.array(votes) == v for v in (-1, 0, 1)], 2).astype(float)
    post = np.where((np.array(votes) < 0).any(1), 0.05, 0.95)
    for _ in range(50):
        good, bad = ((p[:, None, None] * x).sum(0) + 1 for p in (post, 1 - post))
        prior = (post.sum() + 1) / (len(post) + 2)
        odds = math.log(prior / (1 - prior)) + (x * np.log(good / good.sum(1, keepdims=True) / (bad / bad.sum(1, keepdims=True)))).sum((1, 2))
        post = 1 / (1 + np.exp(-odds))
    for r, q in zip(rows, post.tolist(), strict=True):
        r |= {"quality": q, "kept": not r["base_failed"] and q >= 0.5}
    return rows


def test_op4(spark, folder):
    docs = documents(folder)
    want = [{"doc_id": d["doc_id"]} | r for d, r in zip(docs, judged([d["text"] for d in docs]), strict=True)]
    got = run(spark, folder, "op4_quality_rules")
    same(got, want, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    key = lambda r: (str(r["doc_id"]), r["n_words"])
    assert [r["quality"] for r in sorted(got, key=key)] == pytest.approx([r["quality"] for r in sorted(want, key=key)], abs=1e-6)


def leaks(docs, items):
    """(doc, item): best share of an item's BM25 weight in a passage, of items that are verified there."""
    marks = ".,;:!?\"'()[]{}<>«»„“”"
    terms = lambda t: [x for w in (t or "").lower().split() if (x := w.strip(marks))]
    items = [(i, t) for i, x in items if (t := terms(x))]
    mean, df = sum(len(t) for _, t in items) / len(items), Counter(w for _, t in items for w in set(t))
    weight = []
    for _, t in items:
        w = {x: math.log(1 + (len(items) - df[x] + 0.5) / (df[x] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(t) / mean)) for x, n in Counter(t).items()}
        weight.append({x: v / sum(w.values()) for x, v in w.items()})
    stride, out = max(32, *(len(t) for _, t in items)), {}
    for d, text in docs:
        own = terms(text)
        for lo in range(-stride, len(own), stride):
            passage = own[max(0, lo) : lo + 2 * stride]
            held = set(passage)
            for (i, t), w in zip(items, weight, strict=True):
                score = sum(v for x, v in w.items() if x in held)
                if score < 0.6 - 1e-9:
                    continue
                n = min(5, len(t))
                shared, covered = {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}, set()
                for k in range(len(t) - n + 1):
                    covered |= set(range(k, k + n)) if tuple(t[k : k + n]) in shared else set()
                cut = len(t) - max(1, len(t) // 3)
                if sum(k < cut for k in covered) >= 0.8 * cut and sum(k >= cut for k in covered) >= 0.5 * (len(t) - cut):
                    out[d, i] = max(score, out.get((d, i), 0))
    return out


def test_op5(spark, folder):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{folder}/benchmark.parquet").to_pylist()]
    want = leaks([(d["doc_id"], d["text"]) for d in documents(folder)], items)
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in run(spark, folder, "op5_benchmark_leaks")}
    assert want and got.keys() == want.keys() and [got[k] for k in sorted(got)] == pytest.approx([want[k] for k in sorted(got)])


def test_op6_on_held_out_rows(spark, tmp_path):
    """Whole texts of the labelled documents of a larger table: learnt from those that aren't held out, judged on the rest."""
    labels = pq.read_table("/root/testdata/sf0.1/labels.parquet")
    known = {r["doc_id"]: r["toxic"] for r in labels.to_pylist()}
    docs = [r for r in pq.read_table("/root/testdata/sf0.1/documents.parquet").select(TABLE.names).to_pylist() if r["doc_id"] in known]
    pq.write_table(pa.Table.from_pylist([*docs, {"doc_id": -1, "text": None}, {"doc_id": -2, "text": ""}], TABLE), tmp_path / "documents.parquet")
    pq.write_table(labels, tmp_path / "labels.parquet")
    got = {r["doc_id"]: r for r in run(spark, str(tmp_path), "op6_toxicity")}
    assert got.keys() == {*known, -1, -2} and got[-1]["score"] == got[-2]["score"] < 0.3
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())
    judged = [(r["predicted"], known[i]) for i, r in got.items() if r["held_out"] and i in known]
    found, toxic, false = judged.count((1, 1)), sum(y for _, y in judged), judged.count((1, 0))
    assert found >= 0.85 * toxic and false <= 9


def test_op6_scores_by_hand():
    rng = np.random.default_rng(0)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), 0.25, 2.0, -0.5)
    of = lambda word: [*toxicity.subwords(toxicity.plain(word))[0].tolist()]
    for text in ("One, two THREE four-five", "ünïcode é", "a"):
        split = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()
        best = sorted(np.mean([model.weights[b] for b in of(w)]) for w in split)[-toxicity.TOP :]
        assert model.log_odds(text) == pytest.approx(np.mean(best) + 0.25)
    grams = {f" {w} "[i : i + n] for w in ("idiot",) for n in range(3, 7) for i in range(8 - n)}
    assert len(of("idiot")) == 1 + len(grams) and of("IDIOT!") == of("idiot") and len(set(of("idiot")) & set(of("idiott"))) >= 6


def article(page):
    """The article's blocks of a page of the test tables, by patterns."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)
    blocks = re.split(r"</?(?:p|h1|h2|h3|div|ul|ol|li|table|tr|blockquote|pre|section)\b[^>]*>", body.group(1)) if body else []
    plain = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br\s*/?>", " ", b))).split()) for b in blocks]
    return "\n\n".join(x for x in plain if x)


def test_op10(spark, folder):
    want = [{"page_id": r["page_id"], "url": r["url"], "text": (t := article(r["html"])), "n_chars": len(t)} for r in pq.read_table(f"{folder}/pages.parquet").to_pylist()]
    assert all(r["text"] for r in want)
    same(run(spark, folder, "op10_page_text"), want, "page_id", "url", "text", "n_chars")


def components(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words((t or "").translate(LOWER))) else set() for i, t in texts}
    name = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            if name[a] != name[b]:
                name[a] = name[b] = min(name[a], name[b])
                moved = True
    return name


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def redacted(text, spans):
    if text is None:
        return None
    out, at = "", 0
    for s, e in sorted((s, e) for s, _, e, _ in spans):
        out += text[at:s] + "[REDACTED]" if s >= at else ""
        at = max(at, e)
    return out + text[at:]


def test_pipeline_by_plain_python(spark, tmp_path):
    p = pytest.importorskip("corpus_pipeline")
    rows = pq.read_table(f"{SMALL}/documents.parquet").select(TABLE.names).to_pylist()
    long = " ".join(f"alpha{i % 7} the and of beta{i}." for i in range(40))
    rows += [{"doc_id": 3000 + i, "text": t} for i, t in enumerate([long, long + " one more", None, "", f"{long} password=hunter22 {random_tokens(1)[0]}".replace("beta", "gamma")])] + [{"doc_id": None, "text": long}]
    pq.write_table(pa.Table.from_pylist(rows, TABLE), tmp_path / "documents.parquet")
    pq.write_table(pq.read_table(f"{SMALL}/benchmark.parquet"), tmp_path / "benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    docs = [d for d, r in zip(rows, judged([d["text"] for d in rows]), strict=True) if r["kept"]]
    name = components([(d["doc_id"], d["text"]) for d in docs if d["doc_id"] is not None])
    docs = [d for d in docs if d["doc_id"] is None or name[d["doc_id"]] == d["doc_id"]]
    bad = {d for d, _ in leaks([(d["doc_id"], d["text"]) for d in docs if d["doc_id"] is not None], items)}
    docs = [d for d in docs if d["doc_id"] not in bad]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [{"doc_id": d["doc_id"], "ids": lib.encode(redacted(d["text"], s) or ""), "round_trip": True} for d, s in zip(docs, every_span([d["text"] for d in docs]), strict=True)]
    got = [r.asDict() for r in p.run(spark, str(tmp_path)).collect()]
    same(got, want, "doc_id", "ids", "round_trip")
    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "sentencepiece"]
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(1, None, "x", None, None, "kept", 1), (None, "", None, None, 5, None, 2)], "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int")
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).count() == 0
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and out.count() == (0 if stage is p.quality_stage else 2)
