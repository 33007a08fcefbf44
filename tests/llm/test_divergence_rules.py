import math
import random
import re
from collections import Counter

from corpora import corpus

from aulario.llm import divergence_rules as dr


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def distances(texts, langs):
    """Both Jensen-Shannon distances of every text, its word limit and whether it has no common word, by loops."""
    marks, out = ".,;:!?'\"()-_/@+=~^{}[]", []
    classes, common = {}, {}
    own = []
    for t, lang in zip(texts, langs):
        t = t or ""
        c = Counter(
            "space" if ch in " \t\n\x0b\x0c\r" else "digit" if ch in "0123456789" else "symbol" if ch in "#*$%&|<>"
            else "mark" if ch in marks else "upper" if ch.isupper() else "letter" for ch in t
        )
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        s = Counter(x.lower() for x in w if len(x) <= 4 and re.fullmatch("[a-zà-ÿ]+", x.lower()))
        own.append((c, s, len(w)))
        classes.setdefault(lang, Counter()).update(c)
        k = common.setdefault(lang, [Counter(), 0])
        k[0].update(s)
        k[1] += len(w)
    def term(p, q):
        return sum(0.5 * x * math.log2(2 * x / (p + q)) for x in (p, q) if x > 0)
    for (c, s, n), lang in zip(own, langs):
        chars, all_chars = sum(c.values()), sum(classes[lang].values())
        by_class = by_word = None
        limit, without = dr.MAX_WORD_DISTANCE, False
        if chars >= dr.GUARD_CHARS:
            by_class = math.sqrt(max(0, sum(term(c[k] / chars, classes[lang][k] / all_chars) for k in dr.CLASSES)))
        if n >= dr.GUARD_WORDS:
            counts, total = common[lang]
            top = dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: dr.TOP_WORDS])
            q = {k: v / total for k, v in top.items()}
            d = sum(term(s[k] / n, q[k]) for k in q)
            d += term(max(0, 1 - sum(s[k] for k in q) / n), 1 - sum(q.values()))
            by_word = math.sqrt(max(0, d))
            expected = n * sum(q.values())
            if expected >= dr.WORDS_EXPECTED:
                farthest = math.sqrt(max(0, sum(term(0, x) for x in q.values()) + term(1, 1 - sum(q.values()))))
                limit = min(limit, dr.WORD_PART * farthest)
            without = expected >= dr.NONE_EXPECTED and not any(s[k] for k in q)
        out.append((by_class, by_word, limit, without))
    return out


def test_base_and_distances_equal_brute_force(documents):
    texts = corpus(31, 200) + ["a b c d e f g h " * 4 + "x " * 30, "same line of words\n" * 9 + "\n \n", "$# | <> " * 40, "IT!! IS!! " * 60]
    langs = [("en", "de", None)[i % 3] for i in range(len(texts))]
    rows = {r["doc_id"]: r for r in dr.judge(documents(texts, langs)).collect()}
    assert len(rows) == len(texts)
    for i, (t, (c, w, limit, without)) in enumerate(zip(texts, distances(texts, langs))):
        r = rows[3 * i]
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == base(t), t
        for x, y in ((r["class_distance"], c), (r["word_distance"], w)):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9)
        good = (c is None or c <= dr.MAX_CLASS_DISTANCE) and (w is None or w <= limit) and not without
        assert r["kept"] == (good and not r["base_failed"])
    assert not rows[3 * (len(texts) - 2)]["kept"]


def test_a_text_without_common_words_is_rejected_and_short_clean_ones_stay(documents):
    rnd = random.Random(7)
    rare = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(4))
    common = ["the", "of", "and", "to", "in", "is", "it", "was", "for", "on"]
    clean = [" ".join(rnd.choice(common) if rnd.random() < 0.27 else rare() for _ in range(n)) for n in [60] * 100 + [120] * 100 + [400] * 100]
    lists = [" | ".join(rare() for _ in range(n)) for n in [60, 120, 400]]
    rows = {r["doc_id"]: r for r in dr.judge(documents(clean + lists)).collect()}
    assert sum(rows[3 * i]["kept"] for i in range(len(clean))) >= 0.99 * len(clean)
    lists = [rows[3 * (len(clean) + i)] for i in range(len(lists))]
    assert not any(r["kept"] or r["base_failed"] for r in lists)
    words = [" ".join(rare() for _ in range(n)) for n in [60, 120, 400]]
    rows = {r["doc_id"]: r for r in dr.judge(documents(clean + words)).collect()}
    words = [rows[3 * (len(clean) + i)] for i in range(len(words))]
    assert not any(r["kept"] or r["base_failed"] for r in words)
    assert all((r["class_distance"] or 0) <= dr.MAX_CLASS_DISTANCE and r["word_distance"] <= dr.MAX_WORD_DISTANCE for r in words)


def test_no_python_in_the_plan_and_empty_table(documents):
    df = dr.judge(documents(["x"]).limit(0))
    assert df.count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
