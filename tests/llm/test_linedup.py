from collections import defaultdict

from crawlframe.llm import linedup


def brute(rows, min_sites, min_words=3):
    sites, first = defaultdict(set), {}
    for d, t, _, s in rows:
        for pos, raw in enumerate((t or "").split("\n")):
            line = raw.strip(" ")
            if len(line.split()) >= min_words:
                sites[line].add(s)
                first[line] = min(first.get(line, (d, pos)), (d, pos))
    out = {}
    for d, t, _, s in rows:
        if t is None:
            out[d] = (None, 0, 0)
            continue
        lines = t.split("\n")
        kept = [raw for pos, raw in enumerate(lines) if not (
            len(raw.strip(" ").split()) >= min_words and len(sites[raw.strip(" ")] - {None}) >= min_sites and first[raw.strip(" ")] != (d, pos))]
        out[d] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def brute_by_words(rows, rule=linedup.BY_WORDS):
    need = lambda line: [sites for n, sites in sorted(rule) if len(line.split()) >= n][-1]
    sites, first = defaultdict(set), {}
    for d, t, _, s in rows:
        for pos, raw in enumerate((t or "").split("\n")):
            line = raw.strip(" ")
            if line.split():
                sites[line].add(s)
                first[line] = min(first.get(line, (d, pos)), (d, pos))
    out = {}
    for d, t, _, s in rows:
        lines = [] if t is None else t.split("\n")
        gone = [bool(x.split()) and len(sites[x.strip(" ")] - {None}) >= need(x) and first[x.strip(" ")] != (d, pos) for pos, x in enumerate(lines)]
        out[d] = (None if t is None else "\n".join(x for x, g in zip(lines, gone) if not g), len(lines), sum(gone))
    return out


def made(n_sites=40):
    rows = []
    for k in range(400):
        lines = [f"own line number {k}", "Short"]
        lines += [f"spread over {m} sites here" for m in range(1, n_sites) if k % n_sites < m]
        lines += ["  spread over 9 sites here ", ""] * (k % 3)
        rows.append((k, "\n".join(lines), "en", f"site{k % n_sites}"))
    return rows + [(1000, None, None, "site1"), (1001, "", None, "site2"), (1002, "null site has this line", None, None),
                   (1003, "spread over 9 sites here", None, None)]


def test_matches_brute_force_at_every_spread(spark, documents):
    rows = made()
    for min_sites in (2, 9, 20):
        got = linedup.remove_spread_lines(documents(rows), min_sites=min_sites).collect()
        assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got} == brute(rows, min_sites)


def test_sketch_decides_far_lines_and_counts_near_ones(spark, documents):
    rows = [(k, "everywhere on all sites\n" + ("edge of the threshold" if k < 300 else "under the threshold now" if k < 599 else "x"), None, f"s{k}")
            for k in range(3000)]
    got = {r.doc_id: r.n_removed for r in linedup.remove_spread_lines(documents(rows), min_sites=300).collect()}
    assert got[0] == 0 and all(got[k] == 2 for k in range(1, 300)) and all(got[k] == 1 for k in range(300, 3000))


def test_all_occurrences_and_odd_tables(spark, documents):
    rows = [(k, "the same line everywhere\nown text", None, f"s{k}") for k in range(6)] + [(None, "the same line everywhere", None, "s9")]
    got = linedup.remove_spread_lines(documents(rows), keep_first=False).collect()
    assert sorted((r.text for r in got)) == [""] + ["own text"] * 6
    twice = documents(rows[:5] + rows[:1]).withColumnRenamed("lang", "h").withColumnRenamed("n_chars", "id")
    assert sorted(r.n_removed for r in linedup.remove_spread_lines(twice).collect()) == [0, 0, 1, 1, 1, 1]
    assert linedup.remove_spread_lines(documents([])).count() == 0


def test_required_spread_falls_with_length(spark, documents):
    words = lambda name, n: " ".join([name] * n)
    rule = {n: next(s for w, s in reversed(linedup.BY_WORDS) if n >= w) for n in (1, 2, 3, 9, 10, 19, 20, 49, 50, 80)}
    rows, want = [], {}
    for n, sites in rule.items():
        for spread in (sites - 1, sites):
            for k in range(spread):
                rows.append((len(rows), f"{words(f'line{n}of{spread}', n)}\n", None, f"s{k}"))
                want[rows[-1][0]] = int(spread == sites and k > 0)
    docs = documents(rows)
    got = {r.doc_id: r.n_removed for r in linedup.remove_spread_lines(docs, by_words=linedup.BY_WORDS).collect()}
    assert got == want
    few = {r.doc_id: r.n_removed for r in linedup.remove_spread_lines(docs).collect()}
    assert sum(few.values()) < sum(want.values())


def test_rule_by_length_matches_brute_force_and_clashing_columns_pass(spark, documents):
    rows = made() + [(2000 + k, "one\ntwo words\n" + " ".join(["long"] * (20 * (k % 4 + 1))), None, f"site{k % 12}") for k in range(60)]
    docs = documents(rows).withColumnRenamed("lang", "_key").withColumnRenamed("n_chars", "n_removed").selectExpr("*", "7 AS key", "8 AS cut")
    got = linedup.remove_spread_lines(docs, by_words=linedup.BY_WORDS)
    assert got.columns == ["doc_id", "text", "_key", "source", "key", "cut", "n_lines", "n_removed"]
    kept = {r.doc_id: r for r in got.collect()}
    assert {d: (r.text, r.n_lines, r.n_removed) for d, r in kept.items()} == brute_by_words(rows)
    assert all(kept[d]._key == lang and kept[d].source == s and kept[d].key == 7 for d, _, lang, s in rows)


def test_main_path_is_native(spark, documents, capsys):
    linedup.remove_spread_lines(documents(made())).explain()
    assert not any(w in capsys.readouterr().out for w in ("Python", "Arrow", "Pandas"))
