"""The document operators against SQL, brute force, held-out labels and awkward rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F, types as T

import corpus_pipeline
from check_oracle import compare, connect
from conftest import SMALL
from lagline.llm import (
    catalog,
    components,
    decontamination,
    exact_dedup,
    language,
    licenses,
    mixing,
    pseudonyms,
    quality,
    simhash,
    substring_dedup,
    toxicity,
)

MIDDLE = "/root/testdata/sf0.01"

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names the operators use inside.
        *(T.StructField(c, T.StringType()) for c in ("size", "key", "block", "bits", "label", "code_points", "c0")),
        T.StructField("score", T.DoubleType()),
    ]
)
LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))
TWENTY = " ".join(f"word{i}" for i in range(25))
AWKWARD = [
    (1, "the same text here twice", "en", "a"),
    (2, "the same  text\there twice ", "en", "a"),
    (2, "the same  text\there twice ", "en", "a"),
    (3, "", "en", "b"),
    (4, None, None, None),
    (None, None, "de", "b"),
    (None, TWENTY, "de", None),
    (5, TWENTY, "fr", "b"),
    (6, f"before {TWENTY} after", None, "c"),
    (7, LONG, "en", "c"),
    (8, " \n\t ", "es", "c"),
    (9, "x", "es", "z"),
    (10, "Ünïcödé – ñandú 💡 １２３", "es", "z"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(*r, None, *["other"] * 7, 0.5) for r in AWKWARD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def tables():
    con = connect(MIDDLE)
    docs = con.execute("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()
    labels = {r[0]: r[1:] for r in con.execute("SELECT doc_id, quality, toxic FROM labels").fetchall()}
    return docs, labels


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
def test_matches_sql(spark, name, folder):
    con = connect(folder)
    assert compare(catalog.QUERIES[name](spark, folder).toPandas(), con.execute(catalog.ORACLE[name]).df()) == "ok"


@pytest.mark.parametrize("name", ["op4_mixing", "op8_substring_dedup", "op9_exact_dedup"])
def test_sql_agrees_on_awkward_rows(spark, awkward, name, monkeypatch):
    """Where ids are unique and present, SQL says the same on the awkward rows."""
    docs = awkward.where("doc_id IS NOT NULL AND doc_id <> 2")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source").toPandas())
    monkeypatch.setattr(catalog, "documents", lambda *_: docs)
    assert compare(catalog.QUERIES[name](spark, "").toPandas(), con.execute(catalog.ORACLE[name]).df()) == "ok"


# Exact dedup -----------------------------------------------------------------------------


def test_trie_splits_edges_and_spills():
    trie = exact_dedup.Trie(lambda a, b: a + b, len)
    words = [b"abc", b"abd", b"ab", b"abc", b"", b"xyz", b"abcd", b"", b"x"]
    for w in words:
        trie.insert(w, [w])
    first = list(trie.spill(0))
    rest = list(trie.drain())
    groups = sorted(map(tuple, first + rest))
    assert groups == sorted((w,) * n for w, n in Counter(words).items())
    assert trie.total == 0


def test_exact_groups_on_awkward_rows(awkward):
    rows = exact_dedup.exact_groups(awkward).collect()
    assert len(rows) == len(AWKWARD)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    # Rows 1, 2 and 2 again are equal; the longer original wins.
    assert {(r.keep_id, r.group_size) for i in (1, 2) for r in by_id[i]} == {(2, 3)}
    assert {(r.keep_id, r.group_size) for i in (3, 4) for r in by_id[i]} == {(8, 4)}
    assert by_id[8][0].kept and by_id[8][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert by_id[5][0].keep_id == 5 and sorted(r.keep_id for r in by_id[None]) == [5, 8]


def test_small_tries_give_the_same_owners(awkward, monkeypatch):
    docs = awkward.select("doc_id", "text")
    whole = {r.doc_id for r in exact_dedup.owners(docs).collect()}
    assert len(whole) == exact_dedup.owners(docs).count()
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 64)
    assert {r.doc_id for r in exact_dedup.owners(docs).collect()} == whole


def test_deduplicate_keeps_the_columns_and_one_row(awkward):
    kept = exact_dedup.deduplicate(awkward)
    assert kept.schema.names == awkward.schema.names
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7, 8, 9, 10]


# SimHash ---------------------------------------------------------------------------------


def plain_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict[int, int]) -> dict[int, int]:
    owner = {i: i for i in prints}

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                owner[b] = a
    return {i: root(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    expected = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.op3_simhash(spark, SMALL).collect()}
    assert got == {i: (f"{prints[i]:016x}", expected[i]) for i in texts}


@pytest.mark.parametrize("limit", [2, 8, 2048])
def test_links_within_a_ball_of_fingerprints(spark, limit):
    """A tight ball overflows the small limits and goes through all three cuts."""
    import random

    rng = random.Random(limit)
    centre, prints = rng.getrandbits(64), set()
    while len(prints) < 150:
        value = centre
        for b in rng.sample(range(64), rng.randrange(0, 5)):
            value ^= 1 << b
        prints.add(value)
    prints |= {rng.getrandbits(64) for _ in range(50)} | {0, 1, (1 << 64) - 1, (1 << 63)}
    expected = plain_components({p: p for p in prints})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "bits long")
    found = {r.node % (1 << 64): r.component % (1 << 64) for r in components.components(simhash.links(frame, limit)).collect()}
    groups = defaultdict(set)
    for p in prints:
        groups[expected[p]].add(p)
    got = defaultdict(set)
    for p in prints:
        got[found.get(p, p)].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_near_duplicates_on_awkward_rows(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    same = {r.doc_id: r.component_id for r in rows if r.doc_id}
    assert same[1] == same[2] == 1 and same[3] == same[4] == same[8] == 3
    assert {r.component_id for r in rows if r.doc_id is None} == {3, 5}
    kept = simhash.deduplicate(awkward).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 5, 6, 7, 9, 10]


def test_components_of_a_long_path(spark):
    path = spark.range(200).selectExpr("id AS a", "id + 1 AS b").where("a % 50 <> 49").repartition(4)
    found = {r.node: r.component for r in components.components(path).collect()}
    assert found == {i: i // 50 * 50 for i in range(200)}


# Mixing ----------------------------------------------------------------------------------


def test_draws_are_disjoint_exact_and_repeatable(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    mix = mixing.mix(docs).toPandas()
    sources = mix.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert ((sources.taken - sources.target).abs() <= 1).all()
    assert (mix.taken <= 2 * mix["size"]).all()
    assert abs(sources.target.sum() - 1.5 * sources["size"].sum()) < 1
    drawn = mixing.mix(docs).selectExpr("source", "doc_id", "inline(draws)").toPandas()
    assert set(drawn.shard) == set(range(mixing.SHARDS))
    assert drawn.groupby("doc_id").words.sum().to_dict() == mix[mix.taken > 0].set_index("doc_id").taken.to_dict()
    again = mixing.mix(docs.repartition(5)).selectExpr("source", "doc_id", "inline(draws)").toPandas()
    key = ["doc_id", "place"]
    pd.testing.assert_frame_equal(
        drawn.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True)
    )


def test_splitting_tree_keeps_quotas(spark):
    drawn = spark.range(100).selectExpr("CASE WHEN id < 70 THEN 'a' END AS source", "CAST(id AS STRING) AS block", "0 AS turn")
    dealt = mixing.dealt(drawn, 4, "t").toPandas()
    assert len(dealt) == 100 and dealt.groupby("shard").size().tolist() == [25] * 4
    assert dealt.source.notna().sum() == 70


def test_targets_stop_at_twice_the_size(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got[None] == 0
    assert abs(sum(got.values()) - 1.5 * 1110) < 1e-4 and got["b"] == 200


def test_mixing_awkward_rows(awkward):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == len(AWKWARD)
    assert all(r.taken <= 2 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (3, 4, 8)} == {0}


# Language, quality, toxicity ----------------------------------------------------------------


def test_language_of_held_out_documents(spark, tables):
    docs, _ = tables
    got = {r.doc_id: r for r in catalog.op5_language(spark, MIDDLE).collect()}
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert all(got[d[0]].held_out for d in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[d[0]].lang_pred == d[2] for d in held) >= 0.97 * len(held)


def test_backpropagation_agrees_with_differences():
    import numpy as np

    network = language.Network(["a", "b", "c"], seed=2)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    codes = np.array([[97, 98, 99, 97], [100, 97, 97, 98]], np.uint8)
    target = np.array([0, 2])
    gradient, _ = network.gradients(codes, target)
    for name, values in network.p.items():
        at = np.unravel_index(np.abs(gradient[name]).argmax(), values.shape)
        kept = values[at]
        values[at] = kept + 1e-3
        up = network.gradients(codes, target)[1]
        values[at] = kept - 1e-3
        down = network.gradients(codes, target)[1]
        values[at] = kept
        assert abs((up - down) / 2e-3 - gradient[name][at]) < 2e-3


def test_remembered_words_change_nothing():
    network = language.Network(["a", "b"])
    texts = [b"one two two", b"", b"three one", "ñandú ... --".encode()]
    once = language.Reader(network).pooled(texts)
    reader = language.Reader(network)
    each = [reader.pooled([t])[0] for t in texts]
    assert abs(once - each).max() < 1e-6 and not once[1].any()


def test_quality_of_held_out_documents(spark, tables):
    _, labels = tables
    got = {r.doc_id: r for r in catalog.op1_quality(spark, MIDDLE).collect()}
    held = {i: q for i, (q, _) in labels.items() if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(got[i].held_out and got[i].predicted == int(got[i].score >= 0.5) for i in held)
    assert sum(got[i].predicted == q for i, q in held.items()) >= 0.95 * len(held)


def test_toxicity_of_held_out_documents(spark, tables):
    _, labels = tables
    got = {r.doc_id: r for r in catalog.op2_toxicity(spark, MIDDLE).collect()}
    held = {i: t for i, (_, t) in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(got[i].held_out for i in held)
    assert sum(got[i].predicted == t for i, t in held.items()) >= 0.93 * len(held)
    assert sum(got[i].predicted for i, t in held.items() if t == 0) <= 0.02 * len(held)


@pytest.mark.parametrize(
    "clause, kinds",
    [
        ("what an idiot", [toxicity.PLAIN]),
        ("you are an idiot", [toxicity.TARGETED]),
        ("an idiot like you", [toxicity.TARGETED]),
        ("he is not an idiot", [toxicity.NEGATED]),
        ("not one of the many people is an idiot", [toxicity.PLAIN]),
        ("she said idiot", [toxicity.REPORTED]),
        ("i will kill you", [toxicity.THREATENING]),
        ("kill the process", []),
        ("du bist ein dummkopf", [toxicity.TARGETED]),
        ("nothing of the kind", []),
    ],
)
def test_clauses(clause, kinds):
    model = toxicity.Model({})
    found = model.lexicon.symbols(clause.split())
    assert [k for k, _ in model.grammar.clause(*zip(*found))] == kinds


def test_models_on_awkward_rows(awkward, no_labels):
    for rows in (
        quality.scores(awkward, quality.fit(awkward, no_labels)).collect(),
        toxicity.scores(awkward, toxicity.fit(awkward, no_labels)).collect(),
        language.predictions(awkward, language.fit(awkward)).collect(),
    ):
        assert len(rows) == len(AWKWARD)
        assert all(0 <= r.score <= 1 for r in rows)
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {3, 4, 8} <= und and 10 not in und
    assert toxicity.clean(awkward, toxicity.Model({})).count() == len(AWKWARD)


# Pseudonyms --------------------------------------------------------------------------------


def test_digits_are_permuted_one_to_one(spark):
    for n in (1, 2, 3, 5):
        digits = F.lpad(F.col("id").cast("string"), n, "0")
        rows = spark.range(10**n).select(pseudonyms.permuted_digits("k", "t", digits).alias("p")) if n < 5 else None
        if rows is not None:
            got = [r.p for r in rows.collect()]
            assert len(set(got)) == 10**n and {len(p) for p in got} == {n}


def test_dates_are_permuted_one_to_one(spark):
    days = spark.range(0, 73170, 7).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("d"))
    got = days.select(pseudonyms._date("k", F.col("d")).alias("p")).toPandas()
    assert got.p.nunique() == len(got) and got.p.str.match(r"(19|20|21)\d\d-\d\d-\d\d$").all()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    texts = [
        "pay 4111 1111 1111 1111 or 4041894974608795 4337166598464399.",
        "again 4111 1111 1111 1111; not valid 4111 1111 1111 1112",
        "at 97.51.17.173 not 300.1.1.1, call +1 (017) 555-7713, born 2020-02-29 or 31/12/1999, no 2021-02-30",
        "write und.34@mail7.example.com, key 04dbebab91ab85687d33eeaaf9ac699e1188f962",
        "iban GB82WEST12345698765432 ssn 078-05-1120 and 000-12-1234",
        "nothing here at 5 pm",
        "",
        None,
        "Des +1 (826) 555-4081 190.137.223.204 du +44 20 7946 0958 10.1.2.3 ou +33 6 12 34 56 78 4111111111111111",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs, "secret").collect()}
    kinds = {i: [f.kind for f in r.found] for i, r in got.items()}
    assert kinds == {
        0: ["card"] * 3, 1: ["card"], 2: ["ip", "phone", "date", "date"], 3: ["email", "secret"], 4: ["iban", "ssn"],
        5: [], 6: [], 7: [], 8: ["phone", "ip", "phone", "ip", "phone", "card"],
    }
    cards = [f.pseudonym for f in got[0].found]
    assert all(luhn(c.replace(" ", "")) for c in cards) and [len(c) for c in cards] == [19, 16, 16]
    assert got[1].found[0].pseudonym == cards[0] and "4111 1111 1111 1112" in got[1].text
    assert "300.1.1.1" in got[2].text and "2021-02-30" in got[2].text and "97.51.17.173" not in got[2].text
    assert got[2].found[1].pseudonym.startswith("+1 (") and len(got[2].found[1].pseudonym) == 17
    assert got[3].found[0].pseudonym.endswith(".com") and len(got[3].text) == len(texts[3])
    assert "000-12-1234" in got[4].text
    assert got[5].text == texts[5] and got[6].text == "" and got[7].text is None
    assert got[0].text == f"pay {cards[0]} or {cards[1]} {cards[2]}."


def test_planted_values_are_gone(spark):
    import re

    found = re.compile(r"[\w.+-]+@mail\d\.example\.com|(?<!\d)\d{16}(?!\d)|\+1 \(\d{3}\) 555-\d{4}")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in catalog.op6_pseudonyms(spark, MIDDLE).collect()}
    assert set(got) == set(docs)
    numbers = {i: found.findall(t) for i, t in docs.items() if found.search(t)}
    planted = {(i, v) for i, values in numbers.items() for v in values if not v.isdigit() or luhn(v)}
    assert planted and all(v not in got[i] for i, v in planted)
    # Sixteen digits that are no card number are left alone.
    assert all(v in got[i] for i, values in numbers.items() for v in values if v.isdigit() and not luhn(v))
    assert all(got[i] == t for i, t in docs.items() if not re.search(r"[0-9@]", t))


def test_pseudonyms_on_awkward_rows(awkward):
    assert pseudonyms.pseudonymise(awkward, "k").count() == len(AWKWARD)


# Decontamination -----------------------------------------------------------------------------


def folded(text: str) -> str:
    codes, _ = decontamination.fold(text.lower())
    return "".join(map(chr, codes)).strip()


def test_every_contained_item_is_found(spark):
    docs = {r.doc_id: folded(r.text) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    items = {r.item_id: folded(r.text) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()}
    rows = catalog.op7_decontamination(spark, MIDDLE).collect()
    exact = {(d, i) for d, text in docs.items() for i, item in items.items() if item in text}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        piece = docs[r.doc_id]
        assert (r.doc_id, r.item_id) in exact or edit_distance_inside(items[r.item_id], piece) == r.edits


def edit_distance_inside(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        before, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(before[j - 1] + (c != d), before[j] + 1, row[j - 1] + 1)
    return min(row)


def test_edited_items_are_found_with_their_distance():
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    items = [(i, " ".join(rng.choices(words, k=40))) for i in range(12)]
    index = decontamination.Index(items)
    for i, item in items:
        edited, budget = list(item), int(decontamination.RATE * len(item))
        for _ in range(budget):
            at = rng.randrange(len(edited))
            edited[at : at + rng.choice((0, 1, 1))] = rng.choice(("", "q", "z"))
        text = " ".join(rng.choices(words, k=60)) + " " + "".join(edited) + " " + " ".join(rng.choices(words, k=60))
        distance = edit_distance_inside(folded(item), folded(text))
        found = {hit[1]: hit for hit in decontamination.find(index, ["other", text]) if hit[0] == 1}
        assert set(found) == ({i} if distance <= budget else set())
        if found:
            assert found[i][4] == distance


def test_decontamination_of_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, TWENTY), (2, None), (None, TWENTY), (3, "short"), (4, "")], "item_id long, text string")
    rows = decontamination.findings(awkward, items).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0) for r in rows) == [(0, 0), (0, 1), (5, 0), (5, 1), (6, 0), (6, 1)]
    assert sorted(r.doc_id for r in decontamination.clean(awkward, items).collect() if r.doc_id) == [1, 2, 2, 3, 4, 7, 8, 9, 10]
    none = items.limit(0)
    assert decontamination.findings(awkward, none).count() == 0 and decontamination.clean(awkward, none).count() == len(AWKWARD)
    assert decontamination.findings(nothing, items).count() == 0


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    whole = {(r.doc_id, r.item_id) for r in catalog.op7_decontamination(spark, SMALL).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 2000)
    assert {(r.doc_id, r.item_id) for r in catalog.op7_decontamination(spark, SMALL).collect()} == whole


# Substring dedup -------------------------------------------------------------------------------


def plain_removal(docs: list[tuple[int, str]], window: int = 20):
    seen, out = {}, {}
    texts = [(i, (t or "").encode().split()) for i, t in sorted(docs)]
    for i, words in texts:
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            else:
                seen[key] = i, s
        kept = [w for w, g in zip(words, gone) if not g]
        out[i] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1, 4096])
def test_removal_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    base = " ".join(f"a{i}" for i in range(60))
    loop = " ".join(["spin"] * 45)
    texts = [base, f"x {base}", base[:120] + " y " + base[60:], loop, f"{loop} tail", base, "short", "", None, f"{base} {base}"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeated(docs).collect()}
    assert got == plain_removal(list(enumerate(texts)))


def test_removal_on_awkward_rows(awkward):
    rows = substring_dedup.remove_repeated(awkward).collect()
    assert len(rows) == len(AWKWARD)
    found = {r.doc_id: r.n_removed for r in rows if r.doc_id}
    assert found[5] == 0 and found[6] == 25 and found[7] == 0
    assert sorted(r.n_removed for r in rows if r.doc_id is None) == [0, 25]  # behind all ids


# Licenses -----------------------------------------------------------------------------------


def test_license_lines_are_found(spark):
    docs = {r.doc_id: " ".join(r.text.split()).lower() for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    lines = {
        "MIT (line)": "released under the mit license",
        "Apache-2.0 (line)": "licensed under the apache license, version 2.0",
        "GPL-3.0 (line)": "licensed under the gnu general public license, version 3",
        "CC-BY-NC-4.0 (line)": "licensed under cc by-nc 4.0",
    }
    expected = {(d, n) for d, t in docs.items() for n, line in lines.items() if line in t}
    got = {(r.doc_id, r.license) for r in catalog.op10_licenses(spark, MIDDLE).collect()}
    assert expected and expected <= got
    assert all(any(w in docs[d] for w in ("license", "cc by")) for d, _ in got)


def test_edited_notice_and_repeats():
    scanner = licenses.Scanner()
    notice = licenses.TEMPLATES["MIT"][0].split()
    notice[10] = "changed"
    del notice[30:33]
    text = "some words " * 300 + " ".join(notice) + " further words" * 300
    ((name, first, last, share),) = scanner.scan(text.encode())
    assert (name, first, last) == ("MIT", 600, 600 + len(notice) - 1) and 0.9 < share < 1
    assert len(scanner.scan(b"Released under the MIT License. " * 3)) == 3
    assert scanner.scan(b"the license of a driver") == []


def test_patience_is_increasing_and_complete():
    a, b = list("abcbdab"), list("bdcaba")
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    assert licenses.patience(list("abc"), list("xabcy")) == [(0, 1), (1, 2), (2, 3)]
    assert licenses.patience([], list("ab")) == []


def test_licenses_on_awkward_rows(awkward):
    assert licenses.notices(awkward).count() == 0


# Empty tables and the pipeline -----------------------------------------------------------------


def test_empty_tables(spark, nothing, no_labels):
    items = spark.createDataFrame([], "item_id long, text string")
    results = [
        quality.scores(nothing, quality.fit(nothing, no_labels)),
        toxicity.scores(nothing, toxicity.fit(nothing, no_labels)),
        toxicity.clean(nothing, toxicity.Model({})),
        simhash.near_duplicates(nothing),
        simhash.deduplicate(nothing),
        mixing.mix(nothing),
        language.predictions(nothing, language.fit(nothing)),
        pseudonyms.pseudonymise(nothing, "k"),
        decontamination.findings(nothing, items),
        decontamination.clean(nothing, items),
        substring_dedup.remove_repeated(nothing),
        exact_dedup.exact_groups(nothing),
        exact_dedup.deduplicate(nothing),
        licenses.notices(nothing),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_pipeline_equals_its_parts_by_brute_force(spark):
    """Every stage's rule applied by hand to what the stage before it kept."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = toxicity.fit(docs, labels)
    kept = {i: t for i, t in texts.items() if model.score(t) < 0.5}
    groups = defaultdict(list)
    for i, t in kept.items():
        groups[t.encode().translate(None, b" \t\n\x0b\x0c\r")].append(i)
    kept = {i: kept[i] for g in groups.values() for i in [min(g, key=lambda i: (-len(kept[i]), i))]}
    near = plain_components({i: simhash.fingerprint(t.encode()) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if near[i] == i}
    items = [folded(r.text) for r in spark.read.parquet(f"{MIDDLE}/benchmark.parquet").collect()]
    flagged = {i for i, t in kept.items() if any(item in folded(t) for item in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, MIDDLE).collect()}
    assert set(got) <= set(kept) - flagged
    edited = set(kept) - flagged - set(got)
    assert all(min(edit_distance_inside(item, folded(kept[i])) - 0.05 * len(item) for item in items) <= 0 for i in edited)
    assert all(r.size == len(kept[i].encode().split()) for i, r in got.items())
    by_source = defaultdict(list)
    for r in got.values():
        by_source[r.source].append(r)
    assert all(abs(sum(r.taken for r in rows) - rows[0].target) <= 1 for rows in by_source.values())
    assert all(sum(r.size for r in rows) == rows[0].source_size for rows in by_source.values())


def test_stages_keep_the_columns(spark, awkward):
    folder = SMALL
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, awkward, folder).schema.names == awkward.schema.names, name
