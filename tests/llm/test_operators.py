"""The operators against brute force, and on nulls, empty texts, ties, repeated rows and no rows."""

import hashlib
import re
import textwrap
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import chat, decontaminate, fingerprints, jaccard, licences, packing, suffixes, toxicity, urls, warc
from spanloom.llm.common import Steps
from spanloom.llm.components import components
from spanloom.llm.queries import chat_events
from tests.llm.conftest import prose


def shingles(text, size=5):
    words = [w.lower() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", (text or "").encode())]
    if not words:
        return {text} if text else set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def pairs_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


# --- 1 fingerprints


def test_fingerprints(docs, no_docs):
    rows = sorted(pairs_of(docs), key=lambda r: (-r[0] if r[0] is not None else 1 << 62, r[1]))
    want = Counter()
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        want[i, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()] += 1
    found = fingerprints.fingerprint_pairs(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == want
    prints = defaultdict(set)
    for (i, text), r in zip(rows, sorted(found, key=lambda r: (-r.doc_id if r.doc_id is not None else 1 << 62, r.edited_sha256))):
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if i is not None and i != 12:
            prints[text].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and prints[""] == {""}
    assert fingerprints.fingerprint_pairs(no_docs).count() == 0


def test_likeness_is_near_the_exact_one(docs):
    texts = [t for _, t in pairs_of(docs) if t]
    import pyarrow as pa

    sketch = dict(zip(texts, fingerprints.sketches(pa.array(texts))))
    for a, b in combinations(set(texts), 2):
        x, y = shingles(a), shingles(b)
        assert abs(fingerprints.resemblance(sketch[a], sketch[b]) - len(x & y) / len(x | y)) < 0.2
        assert len(x) < 50 or abs(fingerprints.containment(sketch[a], sketch[b]) - len(x & y) / len(x)) < 0.3
    long = max(texts, key=len)
    assert abs(fingerprints.distinct_shingles(sketch[long]) / len(shingles(long)) - 1) < 0.3
    assert np.array_equal(fingerprints.sketch_of(fingerprints.text_of(sketch[long])), sketch[long])


def test_parts_merge_to_the_whole(spark):
    words = prose(9, 900).split()
    parts = [(1, " ".join(words[:400])), (1, " ".join(words[396:])), (2, None)]
    made = fingerprints.merge_sketches(fingerprints.sketch_texts(spark.createDataFrame(parts, "k int, text string"), ["k"]), ["k"])
    whole = fingerprints.sketch_texts(spark.createDataFrame([(1, " ".join(words))], "k int, text string"), ["k"])
    got = {r.k: list(r.sketch) for r in made.collect()}
    assert got == {1: list(whole.first().sketch), 2: []}


# --- 2 chat


def test_events_fold(spark):
    rows = [
        (1, 1, "m1", "message", "user", "Hi </turn> \\ #"), (1, 2, "m2", "message", "assistant", ""), (1, 3, "m2", "delta", None, "He"),
        (1, 4, "m2", "delta", None, "llo"), (1, 5, "m1", "edit", None, "Hi!"), (1, 6, "m2", "regenerate", None, None),
        (1, 7, "m2", "delta", None, "Bye"), (2, 1, "x", "message", None, None), (None, 1, "y", "message", "a:b", "### assistant: x</turn>\n"),
    ]
    events = spark.createDataFrame(rows, "conv_id bigint, seq bigint, message_id string, kind string, role string, text string")
    folded = {(r.conv_id, r.position): (r.role, r.text) for r in chat.fold_events(events).collect()}
    assert folded == {
        (1, 1): ("user", "Hi!"), (1, 2): ("assistant", "Bye"), (2, 1): ("", ""), (None, 1): ("a:b", "### assistant: x</turn>\n"),
    }
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(events))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert back[1].turns_sha256 == sha("user\nHi!\nassistant\nBye\n") and back[1].loss_sha256 == sha("Bye")
    assert back[None].turns_sha256 == sha("a:b\n### assistant: x</turn>\n\n") and back[None].loss_chars == 0
    assert back[2].n_turns == 1
    assert chat.read_back(chat.render(chat.fold_events(events.limit(0)))).count() == 0


# --- 3 similarity join


def brute_links(rows, threshold=0.8):
    sets = [shingles(t) if i is not None else set() for i, t in rows]
    return [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]


def brute_classes(rows):
    links, root = brute_links(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = Counter()
    for a, b in links:
        n[a] += 1
        n[b] += 1
        root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return sorted((i, None if i is None else min(least[find(k)]), n[k]) for k, (i, _) in enumerate(rows) if i is not None)


def test_similarity_classes(docs, no_docs):
    found = jaccard.similarity_classes(docs)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found.collect() if r.doc_id is not None) == brute_classes(pairs_of(docs))
    assert found.filter("doc_id is null").collect()[0].class_id is None
    assert jaccard.similarity_classes(no_docs).count() == 0
    assert jaccard.drop_similar(docs).columns == docs.columns


def test_chains_of_near_copies_and_blocks(spark, monkeypatch):
    """Each copy is near the next ones only, so links lead through many; families split in blocks."""
    words = prose(20, 150).split()
    rows = [(i, " ".join(words[i * 4 : i * 4 + 90])) for i in range(15)] + [(100 + i, " ".join(words[:100] + [f"end{i}"])) for i in range(40)]
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    found = jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found.collect()) == brute_classes(rows)


def test_bands_reach_the_recall():
    bands, rows = jaccard.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (40, 60), (70, 70)], "a bigint, b bigint")
    roots = {r.node: r.root for r in components(links, Steps(spark)).collect()}
    assert roots == {**dict.fromkeys(range(31), 0), 40: 40, 50: 40, 60: 40}


def test_rounds_of_few_links_make_few_files(spark, tmp_path):
    """Each file of a small step is a task, and each round has several steps."""
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        steps = Steps(spark)
        components(spark.createDataFrame([(i, i + 1) for i in range(30)], "a bigint, b bigint"), steps)
    finally:
        spark.conf.set(coalesce, before)
    rounds = [f for f in Path(steps.folder).iterdir() if "star" in f.name]
    assert rounds and all(len(list(f.glob("part-*"))) == 1 for f in rounds)


# --- 4 URLs


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("http://A.Example.ORG:80/es/x?y", "a.example.org:80", "/es/x", None), ("https://www.example.org/es/1#f", "www.example.org", "/es/1", "example.org/es/"),
        ("https://example.org/en/17", "example.org", "/en/17", "example.org/en/1"), ("http://x.org", "x.org", "", None),
        ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/"), ("http://x.com/de/", "x.com", "/de/", "com/de/"), ("telecom/de/", "", "", None),
        ("http://telecom/de/", "telecom", "/de/", None), (None, "", "", None), ("", "", "", None), ("a://b?c://d/e", "b", "", None),
    ],
)
def test_url_rules(spark, url, host, path, rule):
    made = spark.createDataFrame([(url,)], "url string").select(*(c.alias(n) for n, c in zip("hp", urls.url_parts(F.col("url")))))
    got = made.select("h", "p", urls.rule_for(F.col("h"), F.col("p"), urls.RULES)[0].alias("r")).first()
    assert tuple(got) == (host, path, rule)


def test_urls_are_learned(spark):
    good = [(i, f"http://site{i}.net/en/page", 0) for i in range(60)]
    bad = [(100 + i, f"http://s{i}.net/?a={i}&b=1&c=2&d={i * 7919}", 1) for i in range(60)]
    table = spark.createDataFrame(good + bad, "page_id bigint, url string, bad int")
    found = {r.page_id: r.verdict for r in urls.judge_urls(table.select("page_id", "url", F.lit(1).alias("score")), table).collect()}
    assert sum(found[i] == ("block" if b else "allow") for i, _, b in good + bad) >= 114
    none = urls.judge_urls(table.select("page_id", "url"), table.limit(0).select("url", "bad"))
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert urls.judge_urls(table.limit(0).select("page_id", "url"), table).count() == 0


# --- 5 long repeats


def brute_cut(rows):
    seen, out = set(), []
    for i, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = text.encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(data[k : k + 100])
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone) if not g)))
    return out


def cut(docs, **options):
    found = suffixes.remove_repeats(docs, F.col("doc_id"), **options)
    return {tuple(r) for r in found.select("row", "n_bytes", "n_removed", "n_spans", "kept").collect()}


def test_long_repeats(docs, no_docs):
    want = set(brute_cut(pairs_of(docs)))
    assert {(*r[:4], bytes(r[4])) for r in cut(docs)} == want
    assert {(*r[:4], bytes(r[4])) for r in cut(docs, batches=1)} == want
    assert cut(no_docs) == set()
    kept = suffixes.drop_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert kept.filter("n_chars <> length(text)").count() == 0


def test_scan_of_hot_starts_and_long_texts(docs, monkeypatch):
    """Starts beyond the held entries, and texts beyond a piece, give the same result."""
    import pyarrow as pa

    for module, name, value in ((suffixes, "PIECE", 700), (suffixes, "HELD", 3)):
        monkeypatch.setattr(module, name, value)
    data = np.frombuffer(prose(7, 900).encode(), np.uint8)
    offsets = np.array([0, 0, 130, 2500, 2550, len(data)])
    windows = set()
    for _, _, text, position, n in suffixes.entries_of(data, offsets):
        for t, p, k in zip(text, position, n):
            windows |= {(t, p + j) for j in range(k)}
    assert windows == {(t, p) for t in range(5) for p in range(offsets[t + 1] - offsets[t] - 99)}
    start = np.repeat([5, 7, 9], [1, 8, 2])
    run = np.array([1, 1, 1, 2, 3, 4, 5, 6, 7, 1, 1])
    doc, place = np.arange(11), np.arange(11) * 1000
    batch = suffixes._batch([np.ones(11, np.int32), start, run, doc, place, np.ones(11, np.int64)], ["kind", "start", "run", "doc", "place", "n"])
    out = pa.Table.from_batches(list(suffixes._scanned(iter([batch.slice(0, 5), batch.slice(5)])))).to_pylist()
    kinds = defaultdict(set)
    for r in out:
        kinds[r["kind"]].add(r["doc"])
    assert kinds[0] == {2, 10} and kinds[1] == {0, 1, 3, 4, 5, 6, 7, 8, 9} and kinds[3] >= {1, 3, 4, 5, 6, 7, 8}


# --- 6 licences


def test_licences(spark, docs, no_docs):
    lines = [
        (1, "text before\nLicensed under the Apache License, Version 2.0.\nand after"), (2, "Released under the MIT License."),
        (3, "You need a licence to drive.\nThe library is open."), (4, None), (5, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
    ]
    extra = spark.createDataFrame(lines, "doc_id bigint, text string")
    found = {r.doc_id: r for r in licences.scan_licences(extra.unionByName(docs.select("doc_id", "text").filter("doc_id > 5"))).collect()}
    assert [found[i].licence for i in (1, 2, 3, 4)] == ["Apache-2.0", "MIT", None, None]
    assert found[5].licences == "CC-BY-NC-4.0,MIT" and found[5].n_paragraphs == 2 and found[4].n_paragraphs == 0
    assert all(found[i].licence is None for i in (7, 8, 12, 20))
    assert licences.scan_licences(no_docs).count() == 0


NOTICES = {
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


def test_wrapped_notices_and_spdx_lines(spark):
    wanted, rows = {}, []

    def add(text, licences_):
        wanted[len(rows)] = licences_
        rows.append((len(rows), text))

    for family, notice in NOTICES.items():
        for width, mark in ((40, ""), (72, " * "), (76, "# "), (1000, "")):
            lines = [mark + line for line in textwrap.wrap(notice, width)]
            add("\n".join(lines), family)
            add("\n".join([prose(900, 30), *lines, prose(901, 30)]), family)
            add("\n".join([mark + "Copyright 2020 A. Person", mark, *lines, mark, prose(902, 200)]), family)
    whole = "\n\n".join(textwrap.fill(NOTICES[f], 60) for f in ("BSD", "MIT"))
    add(whole, "BSD,MIT")
    for said, families in (("GPL-2.0-or-later", "GPL-2.0"), ("(MIT OR Apache-2.0)", "Apache-2.0,MIT"), ("BSD-3-Clause */", "BSD"), ("ISC", "")):
        add(f"// SPDX-License-Identifier: {said}\n" + prose(903, 20), families)
    add("See the SPDX license list.", "")
    add("\n".join(textwrap.wrap("This program is free and you can use it as you like; the terms of the public library are published by the general manager, who may modify the version of the list at any time.", 50)), "")
    add("\n\n".join(textwrap.wrap(NOTICES["GPL-3.0"], 12)), "")  # single lines tell too little
    found = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: found[i].licences for i in wanted if found[i].licences != wanted[i]} == {}
    assert found[0].n_licensed <= found[0].n_paragraphs == rows[0][1].count("\n") + 1


# --- 7 decontamination


def test_leaks(spark, docs):
    item = prose(30, 40)
    words = item.split()
    swapped = " ".join("other" if k % 9 == 4 else w for k, w in enumerate(words))
    rows = [(1, prose(31, 50) + " " + item), (2, "pre " + swapped + " post"), (3, prose(32, 300)), (4, " ".join(words[10:30])), (5, None), (1, item), (6, " ".join(words[:9]))]
    tests = [(1, item), (2, None), (3, "a b c"), (None, item), (4, "five words make an item")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(tests, "item_id bigint, text string")
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(table, benchmark).collect())
    assert found == [(1, 1), (1, 1), (2, 1), (4, 1)]
    small = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(table, benchmark, block_bytes=10).collect())
    assert small == found
    kept = decontaminate.drop_leaks(docs.unionByName(table.select("doc_id", "text", *(F.lit(None).alias(c) for c in ("row", "kept", "n_chars")))), benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() + 3
    assert decontaminate.find_leaks(table, benchmark.limit(0)).count() == 0 == decontaminate.find_leaks(table.limit(0), benchmark).count()


def test_substitutions_are_found():
    """Of items with one word in eight replaced at random, nearly all are found."""
    import pyarrow as pa
    from spanloom.llm.tokens import buffer_of, word_hashes

    rng, items = np.random.default_rng(5), [prose(100 + k, 36) for k in range(200)]
    block = decontaminate.Block(list(range(200)), [t.encode() for t in items])
    changed = [" ".join("zz" if rng.random() < 0.125 else w for w in t.split()) for t in items]
    found = block.leaks(*word_hashes(*buffer_of(pa.array(changed))))
    assert sum((k, k) in found for k in range(200)) >= 190 and all(a == b for a, b in found)


def test_replaced_words_in_short_items(spark):
    """Items of 6 to 20 words leak as long as three quarters agree, wherever words are replaced."""
    import pyarrow as pa
    from spanloom.llm.tokens import buffer_of, word_hashes

    items = {n: prose(700 + n, n).split() for n in range(6, 21)}
    block = decontaminate.Block(list(items), [" ".join(w).encode() for w in items.values()])
    for place, (n, words) in enumerate(items.items()):
        for k in (1, 2, 3):
            texts = [
                "before it " + " ".join("zz" if j in gone else w for j, w in enumerate(words)) + " after it"
                for gone in combinations(range(n), k)
            ]
            found = block.leaks(*word_hashes(*buffer_of(pa.array(texts))))
            assert sorted(found) == ([(t, place) for t in range(len(texts))] if 4 * k <= n else []), (n, k)
            assert all(row[0] == n - k for row in found.values())
    twenty = [" ".join("zz" if j in gone else w for j, w in enumerate(items[20])) for gone in combinations(range(20), 4)]
    assert len(block.leaks(*word_hashes(*buffer_of(pa.array(twenty))))) == len(twenty)
    rows = spark.createDataFrame([(1, twenty[7]), (2, " ".join(items[20][:12]))], "doc_id bigint, text string")
    tests = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id, r.n_equal) for r in decontaminate.find_leaks(rows, tests).collect()] == [(1, 20, 16)]


def test_every_stretch_that_counts_has_a_seed():
    """All places of n // 4 substitutions among n words, for lengths that longer ones are made of."""
    for masks, sizes in ((decontaminate.SHORT_MASKS, range(4, 12)), (decontaminate.MASKS, range(9, 21))):
        for n in sizes:
            k = n // 4 if n > 9 or masks is decontaminate.SHORT_MASKS and n > 4 else 0
            left = np.ones((len(list(combinations(range(n), k))), n), bool)
            for row, gone in zip(left, combinations(range(n), k)):
                row[list(gone)] = False
            hit = np.zeros(len(left), bool)
            for mask in masks:
                used = [i for i, c in enumerate(mask) if c == "1"]
                for at in range(n - len(mask) + 1):
                    hit |= left[:, [at + i for i in used]].all(axis=1)
            assert hit.all(), (masks, n)


# --- 8 toxicity


def test_toxicity_on_held_out_documents(spark):
    rows = [(i, prose(i + 500, 60) + (" you nasty vile" + " brute" * (i % 3) if i % 4 == 0 else "")) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(table, labels).collect()}
    assert sum(found[i].toxic == (i % 4 == 0) for i in range(200, 400)) >= 196
    assert all(0 <= r.severity <= 2 for r in found.values())
    assert np.mean([found[i].severity for i in range(0, 400, 12)]) < np.mean([found[i].severity for i in range(8, 400, 12)])
    kept = toxicity.drop_toxic(table.withColumn("severity", F.lit("x")), labels)
    assert kept.columns == ["doc_id", "text", "severity"] and 296 <= kept.count() <= 304
    assert toxicity.toxicity(table, labels.limit(0)).filter("toxic").count() == 0
    assert toxicity.toxicity(table.limit(0), labels).count() == 0


def test_a_sample_keeps_the_real_share_of_toxic_documents(spark):
    """One word that half of its documents are toxic with: a sample of a ninth of the clean ones says the same."""
    import pyarrow as pa

    toxic, clean = 150, 2700
    rows = [(i, prose(i + 5000, 30) + (" vile" if (i % 10 if i < toxic else i % 20 == 0) else "")) for i in range(toxic + clean)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < toxic)) for i in range(toxic + clean)], "doc_id bigint, toxic int")
    texts = pa.array(["something vile here", "something else here"])
    whole, small = (toxicity.fit(table, labels, sample_rows=n).chances(texts)[:, 0] for n in (16_000, 600))
    assert abs(whole[0] - 0.5) < 0.1 and abs(small - whole).max() < 0.1, (whole, small)


def test_thresholds_are_ordered():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 3, 300)
    rows = np.repeat(np.arange(300), grades)
    weights, thresholds = toxicity.fit_ordinal(rows, np.zeros(len(rows), int), np.ones(len(rows)), grades, 1)
    assert weights[0] > 0 and thresholds[0] < thresholds[1]


# --- 9 packing


def test_best_bounds_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = sorted(rng.choice(40, 8, replace=False).tolist())
        counts = rng.integers(1, 9, 8).tolist()
        padded = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))
        best = min(padded([*inner, lengths[-1]]) for inner in combinations(lengths[:-1], 2))
        assert padded(packing.best_bounds(lengths, counts, 3)) == best
    assert packing.best_bounds([], [], 3) == []


def test_packing(docs, no_docs):
    rows = packing.pack(docs, max_tokens=100, buckets=4, budget=300, lane_rows=5).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
        assert 0 <= r.padding == r.bucket - r.n_tokens and r.n_tokens <= 100
    count = lambda t: len(re.findall(r"[^\W_]+|[^\w\s]|_", t))
    want = Counter()
    for i, t in pairs_of(docs):
        want[i] += count(t)
    assert total == want
    batches = Counter((r.bucket, r.lane, r.batch) for r in rows)
    assert all(n == 1 or n * b <= 300 for (b, _, _), n in batches.items())
    assert len({(r.bucket, r.lane, r.batch, r.slot) for r in rows}) == len(rows)
    assert packing.pack(no_docs).count() == 0


# --- 10 WARC


def test_archives(spark, tmp_path):
    same = "<p>" + "same " * 40
    rows = [
        (5, "http://a/\r\nX: y", same), (2, None, same), (9, "http://c/", "tiny"), (1, "http://d/", "tiny"), (7, "u", None), (None, "n", same),
        (8, "é", "é" * 100), (8, "é", "é" * 100), (3, "z", prose(1, 3000)), (2, "again", "other text " * 20),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    made = [warc.write_warc(pages.repartition(n), f"{tmp_path}/{n}", shards=3, file_bytes=4000) for n in (1, 4)]
    first, second = ({(r.file, r.bytes, r.sha256, r.records) for r in m.collect()} for m in made)
    assert first == second and len(first) > 2
    found = warc.read_warc(spark, f"{tmp_path}/4").collect()
    text = Counter((r.page_id, bytes(r.payload).decode()) for r in found if r.record_type == "response")
    assert text == Counter((i, t or "") for i, _, t in rows if (i, t) != (5, same))
    revisit = [r for r in found if r.record_type == "revisit"]
    assert [(r.page_id, r.refers_to, r.payload_bytes, r.payload_digest) for r in revisit] == [(5, 2, len(same), hashlib.sha256(same.encode()).hexdigest())]
    assert {r.url for r in revisit} == {"http://a/%0D%0AX: y"}
    assert warc.write_warc(pages.limit(0), f"{tmp_path}/none").count() == 0 == warc.read_warc(spark, f"{tmp_path}/none").count()


def test_events_delivered_again_and_resets_of_one_seq(spark):
    """A repeated row counts once, one reset of a seq wins, and other columns are not read."""
    rows = [
        (1, 0, "m", "message", "user", "wrong"), (1, 2, "m", "edit", None, "e1"), (1, 2, "m", "edit", None, "e2"),
        (1, 2, "m", "delta", None, "-d"), (1, 3, "m", "delta", None, "+"), (1, 3, "m", "delta", None, "+"),
        (1, 4, "n", "message", "assistant", "a"), (1, 5, "n", "delta", None, "b"), (1, 6, "n", "delta", None, "b"),
        (2, None, "o", "message", "user", "x"), (2, None, "o", "message", "user", "x"), (2, None, "o", None, None, None),
        (3, 1, "p", "delta", "user", "only"), (3, 1, "p", "delta", "user", "only"), (3, 2, "p", "delta", None, " deltas"),
    ]
    kinds = "conv_id bigint, seq bigint, message_id string, kind string, role string, text string"
    events = spark.createDataFrame(rows, kinds).selectExpr("*", "'x' as parts", "7 as position", "1 as reset")
    want = [(1, "user", "e2-d+"), (1, "assistant", "abb"), (2, "user", "x"), (3, "user", "only deltas")]
    for copies in (events, events.unionByName(events)):
        got = [(r.conv_id, r.role, r.text) for r in chat.fold_events(copies).orderBy("conv_id", "position").collect()]
        assert got == want


def test_archive_shards_grow_with_bytes(spark, tmp_path):
    """Borders are found by halving as by counting; a plain folder is taken from Spark's store; nothing temporary stays."""
    for borders in ([], [4], [-3, 0, 7], list(range(0, 50, 5))):
        rows = spark.range(-5, 60).select(F.col("id"), warc.shard_of(borders, F.when(F.col("id") != 59, F.col("id"))).alias("shard")).collect()
        assert [r.shard for r in rows] == [0 if r.id == 59 else sum(b <= r.id for b in borders) for r in rows]
    assert warc.qualified(spark, "/a/b") == "file:/a/b" and warc.qualified(spark, "file:/a/b") == "file:/a/b"
    pages = spark.range(100).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.format_string("%0100d", "id").alias("html"))
    shards = [warc.write_warc(pages, f"{tmp_path}/{n}", shard_bytes=n).agg(F.count_distinct("shard")).first()[0] for n in (200, 1 << 20)]
    assert shards == [50, int(spark.conf.get("spark.sql.shuffle.partitions"))]
    assert not (tmp_path / "200" / "_temporary").exists() and warc.read_warc(spark, f"{tmp_path}/200").count() == 100


def test_logs_of_events_fold_back(spark):
    """Streamed, edited and regenerated texts, nulls, empty and long ones, and rows that repeat."""
    rows = [(i % 3, i // 3, "user" if i % 2 else None, t) for i, t in enumerate(["", None, "a", "héllo 😀", "x" * 100_001, "</turn>"] * 4)]
    rows += [(7, 1, "user", "same"), (7, 1, "user", "same"), (8, None, "user", "no turn"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    events = chat_events(df).cache()
    assert {r.kind for r in events.collect()} == {"message", "delta", "edit", "regenerate"}
    got = [(r.conv_id, r.position, r.role, r.text) for r in chat.fold_events(events).collect()]
    want = [(c, None if t is None else t * 8, r or "", x or "") for c, t, r, x in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_licence_sample_takes_ids_before_texts(spark):
    rows = [(i, f"text {i}") for i in range(40)] + [(3, "again"), (None, "no id"), (41, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.text) for r in licences.sampled(df, 10).collect())
    ids = {i for i, _ in got}
    ranked = [r.doc_id for r in df.filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(10).collect()]
    assert ids == {i for i in ranked if i != 41} and got == sorted((i, t) for i, t in rows if i in ids)
    assert licences.sampled(df.limit(0)).count() == 0 == licences.sampled(df.filter("doc_id is null")).count()
