"""Each operator against brute force, round trips or held-out rows, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import SF, compare
from pyspark.sql import functions as F

from threadloom.llm import chat_format as cf
from threadloom.llm import common, decontaminate, near_dedup, quality_rules, source_mix, substring_dedup, token_files, toxicity, url_filter, warc
from threadloom.llm.registry import ORACLES, QUERIES

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "so", "ne", "vi") for b in ("", "ra", "li", "mo", "nu", "pe", "ška", "dó")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    compare(QUERIES[name](spark, SF), ORACLES[name])


# Chat formatting


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "", None, "\\\\h \\l \\n", "####\\", "</turn></turn>\n### x:\n", "a:\nb", "<" * 5 + "#" * 7]
    rows = [(1, i, i, "message", r, t) for i, (r, t) in enumerate(zip(["user", "assistant", None, "as:\nsist", "user", "assistant", "system", "assistant"], hard, strict=True))]
    log = spark.createDataFrame(rows, "conv_id bigint, seq bigint, message_id bigint, event string, role string, text string")
    back = cf.read_back(cf.render(cf.fold(log))).first()
    assert [(t.role, t.text) for t in back.turns] == [(r or "", t or "") for _, _, _, _, r, t in rows]
    assert back.loss_texts == ["", "</turn></turn>\n### x:\n", "<<<<<#######"]
    assert all(back.formatted[m.start : m.start + m.length] == cf_escape(t) for m, t in zip(back.loss_mask, back.loss_texts, strict=True))


def cf_escape(t):
    return t.replace("\\", "\\\\").replace("###", "\\h\\h\\h").replace("</turn>", "\\l/turn>")


def test_chat_events(spark):
    rows = [
        (1, 1, 10, "message", "user", "hi"), (1, 2, 11, "delta", "assistant", "he"), (1, 3, 11, "delta", "assistant", "llo"), (1, 4, 12, "message", "user", "more"), (1, 5, 11, "regenerate", "assistant", None),
        (1, 6, 11, "delta", "assistant", "good "), (1, 7, 11, "delta", "assistant", "day"), (1, 8, 10, "edit", "user", "HI"), (1, 9, 13, "message", "user", "bye"), (None, 1, 1, "odd", None, None),
    ]
    got = [(m.conv_id, m.position, m.role, m.text) for m in cf.fold(spark.createDataFrame(rows, "conv_id bigint, seq bigint, message_id bigint, event string, role string, text string")).orderBy("conv_id", "position").collect()]
    assert got == [(None, 1, "", ""), (1, 1, "user", "HI"), (1, 2, "assistant", "good day"), (1, 3, "user", "bye")]


# Near duplicates


def jaccard(a, b):
    def bag(t):
        w = t.lower().split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    x, y = bag(a), bag(b)
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    texts = []
    passage = prose(rng, 60)
    for _ in range(12):
        base = prose(rng, rng.randint(30, 300)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += [passage + " " + prose(rng, 60) for _ in range(40)] + ["one two", "one  TWO", "one", "", None, "  \n", texts[0].upper()] + [texts[1]] * 30 + ["x y z " * 50, "x y z " * 40]
    df = documents(spark, texts).withColumn("bands", F.lit(1))
    got = {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()}
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "").split() and (texts[j] or "").split() and jaccard(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(texts))}
    kept = near_dedup.keep_first(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {find(i) for i in range(len(texts))}


def test_large_buckets_are_resolved(spark):
    """Small limits send everything through further bands and the last round."""
    rng = random.Random(6)
    base = prose(rng, 120).split()
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 3)):
            copy[rng.randrange(120)] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    config = near_dedup.NearDedupConfig(small=3)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(documents(spark, texts), config=config).collect()}
    assert set(got.values()) == {0} or sum(v != 0 for v in got.values()) == sum(all(jaccard(texts[i], texts[j]) < 0.8 for j in range(60) if j != i) for i in range(60))


def replaced(words, at, name):
    """words with those at the given places replaced by new ones."""
    out = list(words)
    for i in at:
        out[i] = f"{name}{i}"
    return out


def test_documents_outside_a_hubs_component_meet_all_inside_it(spark):
    """More outside documents than `small`, each similar to one inside document alone, and that one no hub."""
    base = [f"w{i}" for i in range(100)]
    inside = [replaced(base, range(9 * k, 9 * k + 9), f"i{k}x") for k in range(10)]
    outside = [replaced(w, [(9 * k + 20 + j) % 90 for j in range(9)], f"o{k}x") for k, w in enumerate(inside)]
    config = near_dedup.NearDedupConfig(shingle=1, bands=8, rows=1, small=1, hubs=1)
    got = near_dedup.classes(documents(spark, [" ".join(w) for w in [base, *inside, *outside]]), config=config).collect()
    assert {r.doc_id: r.class_id for r in got} == dict.fromkeys(range(21), 0)


def test_documents_far_from_the_hub_meet_those_near_them(spark):
    """Chains of edits: the third document of each is beyond twice the hub's reach, the second may be in its component."""
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base)]
    for k in range(16):
        words = base
        for step in range(3):
            words = replaced(words, [(6 * k + 9 * step + j) % 100 for j in range(9)], f"c{k}s{step}x")
            texts.append(" ".join(words))
    config = near_dedup.NearDedupConfig(shingle=1, bands=6, rows=1, small=1, hubs=1)
    got = near_dedup.classes(documents(spark, texts), config=config).collect()
    assert {r.doc_id: r.class_id for r in got} == dict.fromkeys(range(49), 0)


def test_rest_of_a_large_bucket_is_compared_within_it(spark):
    """Pairs away from the hub and its component, that need not share a further band."""
    base = [f"w{i}" for i in range(100)]
    away = [replaced(base, [(7 * k + j) % 100 for j in range(18)], f"a{k}x") for k in range(40)]
    again = [replaced(w, [(7 * k + 30 + j) % 100 for j in range(11)], f"b{k}x") for k, w in enumerate(away)]
    config = near_dedup.NearDedupConfig(shingle=1, bands=3, rows=1, small=1, hubs=1)
    got = {r.doc_id: r.class_id for r in near_dedup.classes(documents(spark, [" ".join(w) for w in [base, *away, *again]]), config=config).collect()}
    assert got == {0: 0} | {k: k for k in range(1, 41)} | {k + 40: k for k in range(1, 41)}


def test_near_duplicates_of_nulls_and_repeats(spark):
    df = documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", "q r s t u v", "k l m n o p"], [None, 7, 9, 7, None])
    assert sorted(map(tuple, near_dedup.classes(df).select("doc_id", "class_id").collect()), key=repr) == sorted([(None, 7), (7, 7), (9, 7), (7, 7), (None, None)], key=repr)
    assert near_dedup.classes(documents(spark, [], [])).count() == 0


def test_variants_of_a_hub_keep_links_to_each_other(spark):
    """500 one-word variants of a text, and for each a further one that is at 0.8 or more to it and below that to the text."""
    rng = random.Random(12)
    hub = [f"w{i}" for i in range(400)]
    texts = [hub]
    for k in range(500):
        at = rng.sample(range(10, 390, 10), 9)
        one = replaced(hub, at[:1], f"v{k}x")
        texts += [one, replaced(one, [*at[1:], at[1] + 3], f"u{k}x")]
    joined = [" ".join(t) for t in texts]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(documents(spark, joined)).collect()}
    far = [k for k in range(500) if jaccard(joined[0], joined[2 * k + 2]) < 0.8 <= jaccard(joined[2 * k + 1], joined[2 * k + 2])]
    lost = [k for k in far if got[2 * k + 2] != got[2 * k + 1]]
    assert len(far) == 500 and len(lost) <= 1 and all(got[2 * k + 1] == 0 for k in range(500))


def test_all_texts_of_a_repeated_id_keep_their_links(spark):
    rng = random.Random(13)
    texts, ids = [], []
    for k in range(60):
        for j in range(2):
            words = prose(rng, 80).split()
            texts += [" ".join(words), " ".join(replaced(words, [40], f"n{k}x"))]
            ids += [k, 1000 + 2 * k + j]
    got = {}
    for r in near_dedup.classes(documents(spark, texts, ids)).collect():
        got.setdefault(r.doc_id, set()).add(r.class_id)
    assert got == {k: {k} for k in range(60)} | {1000 + i: {i // 2} for i in range(120)}


def test_long_and_clashing_near_duplicates(spark):
    rng = random.Random(14)
    long = prose(rng, 60_000).split()
    texts = [" ".join(long), " ".join(replaced(long, range(0, 60_000, 1000), "n")), " ".join(long[:30_000]), "same", "same", None, ""]
    df = documents(spark, texts).withColumns({c: F.lit(1) for c in ("node", "c1", "bands", "class_id")})
    assert {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6}
    assert [r.doc_id for r in near_dedup.keep_first(df).orderBy("doc_id").collect()] == [0, 2, 3, 5, 6]


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**63, 400).astype(np.uint64)
    w1, w2 = rng.integers(1, 9, 400).astype(float), rng.integers(1, 9, 400).astype(float)
    owner = np.repeat([0, 1], 400)
    config = near_dedup.NearDedupConfig(bands=64, rows=16)
    s = near_dedup.dart_signatures(owner, np.concatenate([h, h]), np.concatenate([w1, w2]), 2, config)
    assert abs((s[0] == s[1]).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.06


# Decontamination


def distance(a, b):
    row = list(range(len(b) + 1))
    row = [0] * len(row)
    best = len(a)
    prev = row
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (x != y)))
        prev = now
    return min(prev + [best])


def test_edit_search_is_exact():
    rng = random.Random(2)
    a = ["".join(rng.choice("abé ") for _ in range(rng.choice([1, 2, 5, 63, 64, 65, 70, 128, 140]))) for _ in range(300)]
    b = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 170))) for _ in range(300)]
    assert decontaminate.edit_search(a, b).tolist() == [distance(x, y) for x, y in zip(a, b, strict=True)]


def test_decontamination(spark):
    rng = random.Random(3)
    items = [prose(rng, rng.randint(12, 50)) for _ in range(30)] + ["", None, "Single"]
    rows, want = [], []
    for i in range(120):
        own = prose(rng, rng.randint(0, 200)).split()
        k = rng.randrange(30) if i % 2 else None
        if k is not None:
            words = items[k].split()
            for _ in range(len(words) // 12):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            at = rng.randint(0, len(own))
            own[at:at] = " \n".join(words).upper().split(" ") if i % 4 == 1 else words
        rows.append(" ".join(own))
        want.append(k)
    rows += [None, "", "x single y"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {r.doc_id: [h.item_id for h in r.hits] for r in decontaminate.find(documents(spark, rows).withColumn("hits", F.lit("x")), bench).collect()}
    limit = lambda k, t: distance(items[k].lower(), " ".join(t.lower().split())) <= 0.2 * len(items[k])
    exact = {i: [k for k in range(30) if limit(k, t)] for i, t in enumerate(rows[:120])}
    assert all(set(found[i]) <= set(exact[i]) for i in exact)
    planted = [i for i, k in enumerate(want) if k is not None]
    assert sum(want[i] in found[i] for i in planted) >= 0.97 * len(planted)
    assert found[120] == found[121] == [] and found[122] == [32]
    assert decontaminate.find(documents(spark, rows), bench.limit(0)).where(F.size("hits") > 0).count() == 0
    blocks = decontaminate.DecontaminationConfig(block_bytes=800)
    assert {r.doc_id: sorted(h.item_id for h in r.hits) for r in decontaminate.find(documents(spark, rows), bench, config=blocks).collect()} == {i: sorted(v) for i, v in found.items()}


def test_decontamination_recall_at_all_rates_of_edits(spark):
    """Letters of the items replaced, or replaced, put in and taken out, up to max_edits: 0.9 of those within the limit are found at least, and nothing else."""
    rng = random.Random(21)
    items = [prose(rng, rng.randint(15, 59)) for _ in range(60)]

    def edited(text, rate, mixed):
        out = list(text)
        n = int(rate * len(out))
        for i in rng.sample(range(len(out)), n) if not mixed else [None] * n:
            i = rng.randrange(len(out)) if i is None else i
            kind = rng.randrange(3) if mixed else 0
            out[i : i + 1] = [[rng.choice("abcdefghijklmnop")], [out[i], rng.choice("abcdefgh")], []][kind]
        return "".join(out)

    rows, truth = [], []
    for rate in (0.05, 0.1, 0.15, 0.2):
        for mixed in (False, True):
            for _ in range(60):
                k = rng.randrange(60)
                rows.append(f"{prose(rng, 40)} {edited(items[k], rate, mixed)} \n {prose(rng, 40)}")
                truth.append((k, rate, mixed))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = {r.doc_id: {h.item_id: h.distance for h in r.hits} for r in decontaminate.find(documents(spark, rows), bench).collect()}
    exact = decontaminate.edit_search([items[k].lower() for k, _, _ in truth], [" ".join(r.lower().split()) for r in rows]).tolist()
    for rate in (0.05, 0.1, 0.15, 0.2):
        for mixed in (False, True):
            own = [i for i, t in enumerate(truth) if t[1:] == (rate, mixed) and exact[i] <= int(0.2 * len(items[t[0]]))]
            assert len(own) >= 50 and sum(truth[i][0] in found[i] for i in own) >= 0.9 * len(own), (rate, mixed)
    every = [(i, k) for i, hits in found.items() for k in hits]
    assert all(d <= int(0.2 * len(items[k])) for (i, k), d in zip(every, decontaminate.edit_search([items[k].lower() for _, k in every], [" ".join(rows[i].lower().split()) for i, _ in every]).tolist(), strict=True))


def test_decontamination_leaves_no_match_out(spark):
    """Against the edit distance of every item to every text; every fifth letter is another one, or is gone, so that no seed is left."""
    rng = np.random.default_rng(3)
    alphabet = np.array(list("abcdefgh ijklmnoprstuv\u010d"))
    word = lambda n: "".join(rng.choice(alphabet, n)).strip()
    items = ["q" + word(n) + "w" for n in [3, 7, 11, 16, 21, 30, 44, 64, 80, 120, 233, 300, 390] for _ in range(2)] + ["the thorn the " * 9 + "end"]
    rows = []
    for item in items:
        edits = int(0.2 * len(item))
        for spare in (0, -1):
            replaced, fewer, mixed = list(item), list(item), list(item)
            for j in range(edits - spare):
                at = min(5 * j + 2, len(item) - 1)
                replaced[at], fewer[at] = "Z", ""
                mixed[at] = ("Z", "", mixed[at] + "z")[j % 3]
            rows += [f"{word(40)} {''.join(x)} {word(700)}" for x in (replaced, fewer, mixed)]
    rows += ["the thorn " * 400, "".join(items), None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r.doc_id, h.item_id): h.distance for r in decontaminate.find(documents(spark, rows), bench).collect() for h in r.hits}
    plain = [" ".join(i.lower().split()) for i in items]
    pairs = [(d, k) for d in range(len(rows)) for k in range(len(items))]
    texts = [" ".join((r or "").lower().split()) for r in rows]
    exact = dict(zip(pairs, decontaminate.edit_search([plain[k] for _, k in pairs], [texts[d] for d, _ in pairs]).tolist(), strict=True))
    want = {(d, k): x for (d, k), x in exact.items() if x <= int(0.2 * len(plain[k]))}
    assert len(want) > 3 * len(items)
    assert found == want
    few = decontaminate.DecontaminationConfig(stretch=64, found=50)
    assert {(r.doc_id, h.item_id): h.distance for r in decontaminate.find(documents(spark, rows), bench, config=few).collect() for h in r.hits} == want


def test_decontamination_looks_at_few_places_by_chance():
    """Pieces are more than the edits and disjoint, and are found by chance half as often as those cut at every fourth letter."""
    rng = random.Random(31)
    syllables = ["the", "and", "ing", "ion", "ent", "her", "tha", "nth", "int", "ere", "ter", "est", "ers", "ati", "hat", "ate", "all", "eth", "hes", "ver", "his", "oft", "ith", "fth", "sth"]
    text = lambda n: " ".join("".join(rng.choices(syllables, range(25, 0, -1), k=rng.randint(1, 3))) for _ in range(n))
    config, items, other = decontaminate.DecontaminationConfig(), [*(text(40) for _ in range(60)), "a", "abcd", "aaaaaaaaaaaa"], text(4000)
    pieces = decontaminate.Pieces(items, config)
    for item, cut, edits in zip(items, decontaminate.partition(items, pieces.edits, config), pieces.edits, strict=True):
        assert len(cut) > edits and (cut[1:, 0] >= cut[:-1].sum(axis=1)).all() and cut[0, 0] >= 0 and cut[-1].sum() <= len(item)
    found = 0
    for q, h in enumerate(decontaminate.rolling(decontaminate.codes(other), config.piece), 1):
        if q in pieces.tables:
            found += int(np.diff(pieces.tables[q][0])[pieces.slots(h)].sum())
    fixed = sum(other.count(i[j : j + 4]) for i in items for j in range(0, len(i) - 3, 4))
    assert 0 < found < fixed / 2, (found, fixed)


def test_decontamination_of_odd_rows(spark):
    rng = random.Random(22)
    item = prose(rng, 40)
    items = [item, item, "Single", "ab", "日本語の問題です。答えは何ですか", None, ""]
    rows = [prose(rng, 150_000) + " " + item + " x", item[:20], None, "", "x sinGle y", "aab", "前文。日本語の間題です。答えは何ですか。後文", " \n\t", item.replace(" ", " \n ")]
    bench = spark.createDataFrame(list(zip([9, 4, 5, None, 6, 7, 8], items, strict=True)), "item_id bigint, text string").withColumn("hits", F.lit(1))
    found = {r.doc_id: sorted(h.item_id or -1 for h in r.hits) for r in decontaminate.find(documents(spark, rows).withColumn("item_id", F.lit(1)), bench).collect()}
    assert 4 in found[0] and 4 in found[8] and 5 in found[4] and found[2] == found[3] == found[7] == [] and -1 in found[5] and 6 in found[6] and 4 not in found[1]
    assert decontaminate.find(documents(spark, [], []), bench).count() == 0


# Mixing


def test_mix(spark):
    rows = [(i, f"s{min(i % 7, 3)}", "x" * (i % 50)) for i in range(4000)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("copy", F.lit("clash"))
    target = source_mix.MixTarget(weights={"s0": 1.0, "s1": 3.0}, max_rate=9.0)
    out = source_mix.mix(df, target=target)
    assert set(out.columns) == {"doc_id", "source", "text", "copy", "n_copies", "rate", "shuffle_key"}
    got = out.collect()
    size = {s: sum(len(r.text) for r in got if r.source == s) for s in ("s0", "s1")}
    assert {r.source for r in got} == {"s0", "s1"} and 2.7 < size["s1"] / size["s0"] < 3.3
    assert got == source_mix.mix(df.repartition(3), target=target).collect() or Counter(got) == Counter(source_mix.mix(df.repartition(3), target=target).collect())
    assert all(len({r.shuffle_key for r in got if r.doc_id == d}) == sum(r.doc_id == d for r in got) for d in (7, 8, 14))
    assert source_mix.mix(df.limit(0)).count() == 0


def test_mix_of_a_small_source_reaches_its_target(spark):
    """Its rate is 1 / 1001 of a mix of 1,000,001 characters, and no cap keeps it below."""
    df = documents(spark, ["x" * 1000] * 1000 + ["y"]).withColumn("source", F.col("text").substr(1, 1))
    got = source_mix.mix(df).where("source = 'y'").collect()
    assert abs(got[0].rate - 1_000_001 / 1001) < 1e-6 and 850 < len(got) == got[0].n_copies < 1150


# Toxicity


def test_restoring():
    counts = np.zeros((toxicity.SIZE,) * 3)
    for w in ["idiot", "worthless", "clown", "hello", "letters"] * 50:
        ids = [0, 0, *[toxicity._CLASS[c] for c in w], 0]
        for a, b, c in zip(ids, ids[1:], ids[2:], strict=False):
            counts[a, b, c] += 1
    restore = toxicity.Restorer(toxicity.language_model(counts))
    assert restore("You 1d10t, w.o.r.t.h.l.e.s.s cloooown!!!") == "you idiot, worthless clown!!!"
    assert restore("") == "" and restore("call 555-2748 hello") == "call 555-2748 hello"
    assert len(restore("a1" * 30_000)) > 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    bad = ["zorgun", "blekhed", "fudrak"]
    texts, labels = [], []
    for i in range(1500):
        t = prose(rng, rng.randint(20, 60)).split()
        y = i % 5 == 0
        if y:
            t[rng.randrange(len(t))] = rng.choice([rng.choice(bad), rng.choice(bad) + rng.choice(["en", "ik"]), rng.choice(bad).replace("o", "0").replace("e", "3").upper(), "".join(f"{c}." for c in rng.choice(bad))[:-1]])
        texts.append(" ".join(t))
        labels.append(int(y))
    texts += ["", None]
    docs = documents(spark, texts)
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(1500)]
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels) if not held[i]], "doc_id bigint, toxic int")
    lm = toxicity.language_model(toxicity.trigram_counts(docs))
    out = {r.doc_id: r for r in toxicity.score(docs.withColumn("score", F.lit("x")), lm, toxicity.train(docs, known, lm)).collect()}
    right = [out[i].predicted == labels[i] for i in range(1500) if held[i]]
    assert sum(right) / len(right) > 0.97 and out[1500].score == out[1501].score < 0.5
    assert toxicity.train(docs, known.where("toxic = 0"), lm).score("zorgun") < 0.5


# Substrings


@pytest.mark.parametrize("limits", [(1_000, 8_000), (2, 5)])
def test_substrings_against_brute_force(spark, limits):
    rng = random.Random(8)
    config = substring_dedup.SubstringConfig(length=60, gram=16, contexts=limits[0], chunk=limits[1])
    shared = [prose(rng, 30) for _ in range(4)]
    texts = []
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 40)) for _ in range(3)]
        for _ in range(i % 3):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 2)
            parts.insert(rng.randrange(3), s[a : a + rng.randint(30, len(s))])
        texts.append(" ".join(parts))
    texts += ["ab" * 100, "é" * 70, "\x00" * 90 + "x" * 61, texts[0], texts[0], "", None, "short", shared[0][:60], shared[0][1:60]]
    out = substring_dedup.remove(documents(spark, texts).withColumn("spans", F.lit(0)), config=config).collect()
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in out}
    assert got == dict(enumerate(substring_dedup.brute_force(texts, 60)))


def test_contexts_of_a_hot_anchor_are_not_dealt_to_one_task(spark, monkeypatch):
    rng = random.Random(4)
    config = substring_dedup.SubstringConfig(length=60, gram=16, contexts=20)
    shared = prose(rng, 40)
    texts = [prose(rng, 3) + shared[: 90 + i % 60] + prose(rng, 5) for i in range(300)]
    spread = []

    def kept(df, name, made=None):
        if name == "refined":
            spread.extend(df.withColumn("task", F.spark_partition_id()).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks")).where("n > 40").collect())
        return common.materialize(df, name, made)

    monkeypatch.setattr(substring_dedup, "materialize", kept)
    large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20000"}  # as with large tables
    was = {k: spark.conf.get(k) for k in large}
    try:
        for k, v in large.items():
            spark.conf.set(k, v)
        out = substring_dedup.remove(documents(spark, texts), config=config).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in out}
    assert got == dict(enumerate(substring_dedup.brute_force(texts, 60)))
    assert spread and all(r.tasks > 1 for r in spread), spread


def test_repeat_groups_are_those_of_the_definition():
    """All sets of contexts that agree in a string around the anchor which none of its sides can grow for all of them."""
    rng = random.Random(1)
    config = substring_dedup.SubstringConfig(length=12, gram=4)
    side = lambda n: "".join(rng.choice("xy") if rng.random() < 0.15 else "x" for _ in range(n))
    for _ in range(150):
        made = {}
        for _ in range(rng.randint(2, 9)):
            b = rng.randint(0, 8)
            made[(side(b) + "ABCD" + side(rng.randint(max(0, 8 - b), 8)), b)] = None
        left, right = [p[:b][::-1] for p, b in made], [p[b:] for p, b in made]
        want, every = set(), range(len(made))
        for i in every:
            for a in range(len(left[i]) + 1):
                for z in range(4, len(right[i]) + 1):
                    held = frozenset(k for k in every if left[k].startswith(left[i][:a]) and right[k].startswith(right[i][:z]))
                    grows = lambda sides, n, held=held: all(len(sides[k]) > n for k in held) and len({sides[k][n] for k in held}) == 1
                    if a + z >= 12 and len(held) > 1 and not grows(left, a) and not grows(right, z):
                        want.add((a, z, held))
        got = [(a, z, frozenset(m.tolist())) for a, z, m in substring_dedup.repeat_groups([p.encode() for p, _ in made], np.array([b for _, b in made]), config)]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("contexts", [1_000, 2])
def test_maximal_repeats_with_all_their_places(spark, contexts):
    rng = random.Random(3)
    config = substring_dedup.SubstringConfig(length=60, gram=16, contexts=contexts)
    own = lambda: prose(rng, 12) + " "
    twice, often = prose(rng, 60), prose(rng, 40)
    texts = [own() + twice + "|1", own() + often + "|2", own() + twice + "|3" + own() + often + "|4", own() + often + "|5" + own(), own(), "", None]
    rows = substring_dedup.maximal_repeats(documents(spark, texts).withColumn("length", F.lit("x")), config=config).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.repeat, r.length), []).append((r.doc_id, r.start))
    found = {(len(v), max((texts[d] or "").encode()[s : s + k[1]] for d, s in v)) for k, v in groups.items()}
    assert {len({(texts[d] or "").encode()[s : s + k[1]] for d, s in v}) for k, v in groups.items()} == {1}
    assert any(n == 2 and twice.encode() in t for n, t in found) and any(n == 3 and often.encode() in t for n, t in found)
    assert all(r.n_occurrences == len(groups[r.repeat, r.length]) for r in rows)
    assert substring_dedup.maximal_repeats(documents(spark, [], []), config=config).count() == 0 == substring_dedup.remove(documents(spark, [], []), config=config).count()


def test_intervals_are_those_of_the_definition():
    rng = random.Random(9)
    lcp = [rng.randint(0, 5) for _ in range(60)]
    want = set()
    for i in range(60):
        for j in range(i, 60):
            m = min(lcp[i : j + 1])
            if m >= 2 and (i == 0 or lcp[i - 1] < m) and (j == 59 or lcp[j + 1] < m):
                want.add((m, i, j + 1))
    assert sorted(substring_dedup.intervals(np.array(lcp), 2)) == sorted(want)


# Quality


def test_quality_edges(spark):
    menu = "Home | About | Contact | Blog\n"
    good = "This is a plain sentence with quite a few words in it. " * 5
    texts = [None, "", " \n ", menu * 10, menu + good, "A " * 30, "same line here.\n" * 30, prose(random.Random(1), 50_000) + "."]
    df = documents(spark, texts).withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("y"))
    out = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert [out[i].kept for i in range(8)] == [False, False, False, False, False, False, False, True]
    assert out[4].cleaned_text == good and out[4].line_reasons == ["navigation"] and out[3].n_lost_words == out[3].n_words and out[6].n_dup_lines == 29
    assert out[5].n_repeat_words == 30 and out[7].n_words == 50_000 and out[0].n_words == 0
    assert quality_rules.judge(df.limit(0)).count() == 0 and [r.doc_id for r in quality_rules.keep_good(df).collect()] == [7]


def spark_and_duck(spark, tmp_path, query, sql, **tables):
    """The query and its SQL on tables of our own."""
    import duckdb

    db = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    out = db.execute(sql)
    names = [d[0] for d in out.description]
    got = query(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(r[n] for n in names) for r in got.collect()]
    assert Counter(rows) == Counter(tuple(r) for r in out.fetchall())
    return got


def test_quality_of_line_ends(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    ended, open_ = words + " end.", words + " end"
    texts = [
        "\r\n".join([ended] * 2 + [open_, ended]), "\n".join([ended, open_ + ".\"'”’»)]", ended + " \t\r", open_ + ".' )"]), f"{ended}\n{open_}\n\n \n", f"{open_}\n{ended}", open_ * 3, f"{open_} 7\r\n{ended}",
        f"{ended}\n" + "please read our privacy policy " * 30 + f".\n{ended} {ended}", f"{ended}\n" + (words + " ") * 20 + f"privacy policy.\n{ended} {ended}", "a | b | c\r\n" + ended * 2, "x |\t| y |\n" + ended * 2, "", None, "\r\n", ended + "\x0b",
    ]
    got = {r.doc_id: r for r in spark_and_duck(spark, tmp_path, quality_rules.op7_quality_rules, quality_rules.OP7_SQL, documents=documents(spark, texts)).collect()}
    assert [got[i].n_lost_words for i in range(9)] == [16, 0, 0, 16, 0, 0, 151, 0, 5]


def test_chat_ties_and_odd_logs(spark, tmp_path):
    rows = [(1, 0, "user", t) for t in ("b", "a", None, "a", "", "c" * 200_000)] + [(1, 0, "assistant", "z"), (2, None, None, "x"), (2, 1, "assistant", "</turn>"), (None, 1, "user", "n")]
    log = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("loss", F.lit(1)).withColumn("position", F.lit("x"))
    spark_and_duck(spark, tmp_path / "a", cf.op1_chat_format, cf.OP1_SQL, conversations=log)
    spark_and_duck(spark, tmp_path / "b", cf.op1_chat_format, cf.OP1_SQL, conversations=log.limit(0))


def test_mix_against_its_sql_where_sources_are_small(spark, tmp_path):
    rows = [(i, "large", "x" * 900) for i in range(60)] + [(100, "small", "y"), (101, None, "zz"), (102, "empty", ""), (None, "large", "long " * 20_000)]
    spark_and_duck(spark, tmp_path, source_mix.op4_source_mix, source_mix.OP4_SQL, documents=spark.createDataFrame(rows, "doc_id bigint, source string, text string"))


# WARC


def test_loser_tree():
    class Fake:
        def __init__(self, rows):
            self.rows, self.head = list(rows), None
            self.advance()

        def advance(self):
            self.head = self.rows.pop(0) if self.rows else None

    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(((rng.choice("abc"), rng.randint(0, 9), rng.randint(0, 99), None, "f", i) for i in range(rng.randint(0, 20))), key=warc._sort_key) for _ in range(k)]
        assert list(warc.LoserTree([Fake(r) for r in runs])) == sorted((x for r in runs for x in r), key=warc._sort_key)


def test_archives(spark):
    big = "<p>" + "é" * 100
    rows = [(5, "http://a.b/x", big), (2, "http://b.a/", big), (9, None, big), (1, "http://é.example/\n?q=%41", "small"), (3, "u", "small"), (4, "", None), (7, "http://a.b/x", "y" * 100), (None, "http://n", big), (None, "http://n", "z" * 200)] + [(100 + i, f"http://h/{i % 3}", f"{i}" * 60) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, payload string").withColumn("captured", F.coalesce("page_id", F.lit(0)) * 10).withColumn("digest", F.lit(1))
    config = warc.WarcConfig(file_bytes=4000, fan_in=3, run_batch=7, range_entries=50)
    folder = common.new_folder(spark, "warc")
    runs = warc.write_archives(warc.with_revisits(pages, config), folder, config)
    index = warc.merged_index(runs, folder, config)
    order = [(r.urlkey, r.captured, r.page_id or 0) for r in index.orderBy("index_part", "index_row").collect()]
    assert order == sorted(order) and len(order) == len(rows) and index.select("index_part").distinct().count() > 3
    read = warc.read_archives(index, warc.WarcConfig(read_bytes=2000))
    assert read.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 3
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read.collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got[2] == (203, sha(big), "response", None) and got[5] == (203, sha(big), "revisit", 2) and got[9][3] == 2
    assert got[1][2] == got[3][2] == got[7][2] == "response" and got[4][:2] == (0, sha(""))
    assert warc.url_key("https://WWW.Example.com:80/a?b#c") == "com,example,www:80)/a?b" and warc.url_key(None) == ""
    empty = warc.write_archives(warc.with_revisits(pages.limit(0)), folder)
    assert warc.read_archives(warc.merged_index(empty, folder)).count() == 0


# Tokens


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    fmt = token_files.default_format()
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 300)) for _ in range(60)] + [None, "", "  two\n\n lines \t x", "it's <|endoftext|> \x1c\x85  12ab!!", "x" * 5000, "dup", "dup"]
    ids = [*range(len(texts) - 2), 3, None]
    small = token_files.TokenFormat(fmt.tokenizer, sequence_length=16, batch_sequences=4, remembered=50)
    manifest = token_files.write_sequences(documents(spark, texts, ids).withColumn("start", F.lit(1)), "doc_id", "text", common.new_folder(spark, "tokens"), small)
    got = [(r.key, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(manifest).collect()]
    tokenizer = Tokenizer.from_file(fmt.tokenizer)
    assert 50256 in tokenizer.encode(texts[63], add_special_tokens=False).ids
    want, at, stream = [], 0, []
    for i, t in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        own = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
        stream += own
    assert sorted(got, key=lambda r: r[1]) == want
    monkeypatch.setattr(token_files, "READ_SLICES", 1)
    again = token_files.read_documents(manifest)
    assert sorted(((r.key, r.start, r.n_tokens, r.ids_crc32) for r in again.collect()), key=lambda r: r[1]) == want
    assert manifest.count() == 1 or again.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1
    rows = manifest.orderBy("part").collect()
    back = []
    for r in rows:
        file = token_files.Sequences(r.file)
        for b in range(file.batches):
            x, m = file.batch(b), file.batch(b, "mask")
            back += x[m].tolist()
        assert file.sequence(0).base is not None and (file.sequence(1) == file.batch(0)[1]).all() if file.batches and file.rows > 1 else True
        file.close()
    assert back == stream
    assert token_files.read_documents(token_files.write_sequences(documents(spark, [], []), "doc_id", "text", common.new_folder(spark, "tokens"), small)).count() == 0


# URLs


def test_urls(spark):
    cases = {
        "http://A.Example.COM/en/x?y#z": ("a.example.com", "/en/x", "example.com/en/", "block"), "https://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://foo.com": ("foo.com", "", None, None), "http://foo.com/": ("foo.com", "/", "com/", "allow"), "http://ÀB.net/fr/?q": ("Àb.net", "/fr/", "net/fr/", "block"), "nothing": ("", "", None, None),
        "http://xcom/": ("xcom", "/", None, None), "http://a.net?x/es/": ("a.net", "", None, None), "http://a.net#/es/": ("a.net", "", None, None),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*cases, None])], "page_id bigint, url string").withColumn("host", F.lit("x"))
    model = url_filter.fit(["http://a.com/1"] * 60 + ["http://b.net/aaaa?b=1&c=2"] * 60, np.array([0] * 60 + [1] * 60, float))
    out = {r.url: r for r in url_filter.classify(pages, model).collect()}
    for u, (host, path, rule, verdict) in cases.items():
        r = out[u]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict) and r.verdict in ("allow", "block")
    assert (out[None].host, out[None].path) == ("", "") and out["http://a.net?x/es/"].verdict in ("allow", "block")


URL_SQL = """
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r), p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM h),
l AS (SELECT * FROM (VALUES ('com', '/', 'com/'), ('example.com', '/en/', 'example.com/en/'), ('www.example.com', '/en/', 'www.example.com/en/'), ('net', '/es/', 'net/es/'), ('net', '/fr/', 'net/fr/')) AS t(rh, rp, rule))
SELECT page_id, host, path, (SELECT arg_max(rule, length(rule)) FROM l WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule FROM p
"""


def test_hosts_paths_and_rules_against_sql(spark, tmp_path):
    rng = random.Random(8)
    ends = ["/", "", "/en/x", "/es/", "/fr/?q", "?a=/es/", "#/", "/fr", "/\n/x", "//en/"]
    urls = [f"{rng.choice(['http', 'x://y'])}://{rng.choice(['', 'www.', 'a.WWW.', 'not'])}{rng.choice(['example.com', 'Example.NET', 'net', 'com', 'x.org', '', '.com', 'É.net'])}{rng.choice(ends)}" for _ in range(300)] + [None, "", "://", "u" * 50_000, "http://" + "a." * 5_000 + "net/fr/" + "p" * 50_000]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id bigint, url string, html string")
    query = lambda s, d: url_filter.op10_url_filter(s, d).select("page_id", "host", "path", "rule")
    spark_and_duck(spark, tmp_path / "a", query, URL_SQL, pages=pages)
    spark_and_duck(spark, tmp_path / "b", query, URL_SQL, pages=pages.limit(0))


def test_content_labels_and_held_out_urls(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        bad = rng.random() < 0.15
        url = f"http://{'win-' + str(rng.randint(0, 99)) if bad else 'news'}.site{rng.randint(0, 9)}.org/" + ("p/" * rng.randint(3, 6) + "?a=1&b=2&c=3" if bad else "story")
        rows.append((i, url, f"<html><script>casino</script><p class='casino'>{prose(rng, 30)} {'best CASINO here' if bad and i % 2 else 'bu%%% ne*** ' * 12 if bad else ''}</p>", bad))
    pages = spark.createDataFrame([*rows, (900, "http://x", None, None), (901, None, "<p></p>", None)], "page_id bigint, url string, html string, bad boolean")
    labels = url_filter.content_labels(pages)
    assert labels.count() == 900 and labels.where("block = 1").count() == sum(r[3] for r in rows)
    model = url_filter.train(url_filter.content_labels(pages.where("page_id % 3 <> 1")))
    out = url_filter.classify(pages.where("page_id % 3 = 1 AND bad IS NOT NULL"), model, rules=()).collect()
    assert sum((r.verdict == "block") == r.bad for r in out) / len(out) > 0.97 and {r.verdict for r in out} == {"allow", "block"}


def test_trees_learn():
    rng = random.Random(3)
    urls = [f"http://h{rng.randint(0, 50)}.org/" + "/".join("p" * rng.randint(1, 9) for _ in range(rng.randint(1, 6))) + ("?a=1&b=2" if rng.random() < 0.5 else "") for _ in range(3000)]
    y = np.array([float(u.count("/") > 5 or "b=2" in u) for u in urls])
    model = url_filter.fit(urls[:2000], y[:2000])
    x = np.array([url_filter.features(u, *url_filter.split_url(u), model.known, model.prior) for u in urls[2000:]])
    assert ((model.scores(x) >= 0.5) == y[2000:]).mean() > 0.98
    assert json.dumps(model.nodes) == json.dumps(url_filter.fit(urls[:2000], y[:2000]).nodes)
    one = url_filter.fit(["a", None], np.array([1.0, 1.0]))
    assert 0.5 < one.scores(np.zeros((1, len(url_filter.FEATURES))))[0] < 1


# Shared


def test_span_hashes_and_words():
    data = np.frombuffer("  ab c\tab\n".encode(), dtype=np.uint8)
    start, end, row = common.word_spans(data, np.array([0, 4, 4, 10]))
    assert [data[a:b].tobytes() for a, b in zip(start, end, strict=True)] == [b"ab", b"c", b"ab"] and row.tolist() == [0, 2, 2]
    h = common.SpanHash(data)(start, end)
    assert h[0] == h[2] != h[1]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    loops = {x for x in parent if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: find(x) for x in parent if x not in loops}


def test_passages_of_words(spark, monkeypatch):
    rng = random.Random(9)
    long, short = prose(rng, 50), prose(rng, 49)
    texts = [f"{prose(rng, 30)} {long} {prose(rng, 9)}", f"{prose(rng, 80)}\n{long.replace(' ', '  ')}", f"{short} {prose(rng, 60)}", f"{prose(rng, 70)} {short}", prose(rng, 200), None, "", "no"]
    docs = documents(spark, texts).select("doc_id", F.xxhash64("text").alias("th"), "text")
    assert sorted(r.doc_id for r in substring_dedup.passages(docs).collect()) == [0, 1]
    out = {r.doc_id: (r.shared, len(r.removed)) for r in substring_dedup.remove(documents(spark, texts), words=50).collect()}
    assert out == {i: (i < 2, 0) for i in range(len(texts))}
    assert {r.shared for r in substring_dedup.remove(documents(spark, texts)).collect()} == {None}
    # Large groups of keys that are too many to broadcast are dealt in shares, with the same result.
    keyed = spark.createDataFrame([(k, h, h * 7) for k in range(5) for h in range(10 * k)], "key bigint, h bigint, ctx bigint")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    want = sorted(map(tuple, substring_dedup.with_sizes(keyed, sizes, 15).select("key", "h", "ctx", "n").collect()))
    monkeypatch.setattr(substring_dedup, "BROADCAST_KEYS", 1)
    assert sorted(map(tuple, substring_dedup.with_sizes(keyed, sizes, 15).select("key", "h", "ctx", "n").collect())) == want
    assert len(want) == 100
