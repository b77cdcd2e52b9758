"""Vector operators, extraction and the pipeline against brute force."""

import hashlib
import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import embdup, html_text, nearest, queries

VEC = "vec_id long, embedding array<float>, label int, kept string, rank int"


def vectors(spark, seed=0, n=900, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    for i in range(0, 120):
        x[i] = x[i % 4] + rng.normal(size=d).astype(np.float32) * 0.08
    x[200:230] = x[200]
    x[240] = 2 * x[241]
    rows = [(i, [float(v) for v in x[i]], int(i % 3) if i >= 120 else 1, "k", 7) for i in range(n)]
    rows[50] = (50, rows[50][1], None, "k", 7)
    rows += [(n, None, 1, None, None), (n + 100, [0.0] * d, 1, None, None), (n + 2, [float("nan")] * d, 1, None, None), (n + 3, [None, *[1.0] * (d - 1)], 1, None, None), (None, rows[0][1], 1, None, None), (5, rows[5][1], 1, "k", 7)]
    return rows, spark.createDataFrame(rows, VEC).repartition(3)


def usable(rows):
    return {r[0]: (np.array(r[1], np.float64), r[2]) for r in rows if r[0] is not None and r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}


def brute_links(rows, reach=0.93):
    """(vec_id, n_links, component_id, kept) for each row, by all pairs of rows."""
    size = len(max((r[1] for r in rows if r[1]), key=lambda v: sum(len(r[1] or ()) == len(v) for r in rows)))
    good = [k for k, r in enumerate(rows) if r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) == size and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    x = np.array([rows[k][1] for k in good], np.float64)
    norm = np.sqrt((x * x).sum(1))
    lab = np.array([rows[k][2] for k in good])
    link = ((x @ x.T) / (norm[:, None] * norm[None]) >= reach - 1e-12) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    least = np.array([rows[k][0] for k in good])
    while True:
        low = np.minimum(least, np.where(link, least[None], least[:, None]).min(1))
        if (low == least).all():
            break
        least = low
    found = {k: (int(link[i].sum()), int(least[i])) for i, k in enumerate(good)}
    return sorted(map(repr, ((r[0], *found.get(k, (0, r[0])), r[0] is None or found.get(k, (0, r[0]))[1] == r[0]) for k, r in enumerate(rows))))


def linked(df):
    return sorted(map(repr, ((r.vec_id, r.n_links, r.component_id, r.kept) for r in embdup.near_duplicate_vectors(df).collect())))


@pytest.mark.parametrize("shard,part", [(1024, 2048), (32, 24)])
def test_embedding_links_equal_brute_force(spark, monkeypatch, shard, part):
    monkeypatch.setattr(embdup, "SHARD", shard)
    monkeypatch.setattr(embdup, "PART", part)
    rows, df = vectors(spark)
    assert linked(df) == brute_links(rows)


def test_lengths_labels_and_one_large_component(spark):
    rng = np.random.default_rng(8)
    steps = np.cumsum(rng.normal(size=(300, 12)) * 0.09, 0) + rng.normal(size=12) * 3
    rows = [(i, [float(c) for c in v], 1, "k", 7) for i, v in enumerate(steps)]
    rows += [(1000 + i, [1.0] * (40 + i), 1, "k", 7) for i in range(3)] + [(2000, [1e9] * 12, 1, None, None), (2001, [1e-30] * 12, 1, None, None), (None, [1.0] * 12, 1, None, None), (None, None, None, None, None)]
    assert linked(spark.createDataFrame(rows, VEC).repartition(3)) == brute_links(rows)
    none = [(i, r[1], None, None, None) for i, r in enumerate(rows[:20])]
    assert linked(spark.createDataFrame(none, VEC)) == brute_links(none + [(99, [1.0] * 12, 1, None, None)])[:20]


def test_links_of_tight_groups_beyond_a_list(spark, monkeypatch):
    monkeypatch.setattr(embdup, "PART", 512)
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for label, (groups, size) in enumerate([(10, 100), (20, 60)]):
        x = np.repeat(rng.normal(size=(groups, 64)), size, 0) + rng.normal(size=(groups * size, 64)) * 0.02
        for i, v in enumerate(x):
            want[len(rows)] = (size - 1, len(rows) - i % size)
            rows.append((len(rows), [float(c) for c in v], label, "k", 7))
    got = embdup.near_duplicate_vectors(spark.createDataFrame(rows, VEC).repartition(3)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_edges_join_all_components():
    x = np.repeat(np.random.default_rng(1).normal(size=(6, 8)), 50, 0) + np.random.default_rng(2).normal(size=(300, 8)) * 0.01
    x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
    nb = embdup.pruned(x)
    a, b = np.repeat(np.arange(300), nb.shape[1])[nb.ravel() >= 0], nb.ravel()[nb.ravel() >= 0]
    more = embdup.joined(x, a, b)
    root = np.arange(300)
    for i, j in zip(np.concatenate([a, more[0]]), np.concatenate([b, more[1]])):
        root[root == root[i]] = root[j]
    assert len(more[0]) >= 5 and len(set(root.tolist())) == 1


def test_nearest_neighbours_reach_the_recall(spark):
    rows, df = vectors(spark, n=2500)
    good = usable(rows)
    ids = np.array(sorted(good))
    x = np.stack([good[i][0] for i in ids])
    got = nearest.nearest(df, k=10).collect()
    asked = sorted(i for i in good if i % 100 == 0)
    assert sorted({r.query_id for r in got}) == asked
    hit = 0
    for q in asked:
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [o[0] for o in own] == list(range(1, 11))
        d = np.sqrt(((x - good[q][0]) ** 2).sum(1))
        assert all(s == pytest.approx(d[np.searchsorted(ids, v)], abs=1e-12) for _, v, s in own)
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        order = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hit += len(set(order) & {v for _, v, _ in own})
    assert hit >= 0.9 * 10 * len(asked)


def found_share(rows, got, k=10):
    """The share of each query's true k nearest distances that are reached."""
    good = usable(rows)
    ids = np.array(sorted(good))
    x = np.stack([good[i][0] for i in ids])
    share = []
    for q in [i for i in good if i % 100 == 0]:
        d = np.sqrt(((x - good[q][0]) ** 2).sum(1))
        far = np.sort(d[ids != q])[:k][-1]
        share.append(sum(r.score <= far * (1 + 1e-12) for r in got if r.query_id == q) / min(k, len(ids) - 1))
    return float(np.mean(share))


def test_nearest_neighbours_beside_large_far_and_shifted_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16)) + 1000
    x[7] = 1e9
    x[8] = 1e-9
    rows = [(i, [float(c) for c in v], 1, "k", 7) for i, v in enumerate(x)] + [(5000 + i, [1.0] * 17, 1, None, None) for i in range(3)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string, rank int").repartition(3)).collect()
    assert found_share(rows[:2000], got) >= 0.95 and {r.query_id for r in got} == set(range(0, 2000, 100))


def test_nearest_neighbours_by_blocks_if_the_graph_falls_short(spark, monkeypatch):
    monkeypatch.setattr(nearest, "WIDEST", 1)
    monkeypatch.setattr(nearest, "BLOCK", 3)
    rows, df = vectors(spark, n=1200)
    got = nearest.nearest(df, beam=10, width=1, degree=2, rounds=0, recall=1.01).collect()
    assert found_share(rows, got) == 1.0


def test_ties_beyond_the_members_of_a_node(spark):
    rows = [(i, [1.0, 2.0], 1, None, None) for i in range(0, 400)] + [(1000 + i, [3.0, float(i)], 1, None, None) for i in range(50)]
    got = nearest.nearest(spark.createDataFrame(rows, VEC).repartition(3)).orderBy("query_id", "rank").collect()
    for q in (0, 100, 200, 300):
        assert [(r.rank, r.vec_id, r.score) for r in got if r.query_id == q] == [(k + 1, v, 0.0) for k, v in enumerate([i for i in range(11) if i != q][:10])]
    assert len([r for r in got if r.query_id == 1000]) == 10


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, None, None), (1, [0.0, 1.0], 1, None, None), (2, [1.0, 0.1], 1, None, None)], VEC)
    assert [(r.rank, r.vec_id) for r in nearest.nearest(df).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    none = df.filter("vec_id > 9")
    assert nearest.nearest(none).count() == 0 and embdup.near_duplicate_vectors(none).count() == 0


def test_main_text(spark):
    page = '<html><head><title>T</title><script>x("<p>no</p>")</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy now</div><article><h1>Big &amp; small</h1><p>First   block\n of <i>text</i>, long enough &lt;ok&gt;.</p><p><b>Second block.<br><p>Third &eacute; one, with words in it.</p></article><div class="comments"><p>I like it</p></div><footer>&copy; me</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page, 3), (2, None, None, 3), (3, "u", "", 3), (None, "u", page, 3), (4, "u", "<nav>" + "<a href=x>m</a>" * 50, 3)], "page_id long, url string, html string, n_chars int")
    got = {(r.page_id, r.url): r for r in html_text.main_text(df).collect()}
    assert got[(1, "u")].text == "Big & small\n\nFirst block of text, long enough <ok>.\n\nSecond block.\n\nThird é one, with words in it."
    assert got[(None, "u")].text == got[(1, "u")].text and got[(1, "u")].n_chars == len(got[(1, "u")].text)
    assert got[(2, None)].text == "" and got[(3, "u")].n_chars == 0 and got[(4, "u")].text == ""
    assert html_text.main_text(df.limit(0)).count() == 0


def test_blocks_after_scripts_heads_and_unclosed_elements():
    text = lambda page: [b[1] for b in html_text.blocks(page)]
    assert text("<script>for(var i=0;i<n;i++){f(i)}</script><article><p>One</p></article><script>x='</p>'</script ><p>Two") == ["One", "Two"]
    assert text("<style>a<b{}</STYLE><p>One</p><script>if (a<b) {") == ["One"]
    assert text("<html><head><title>t <b></title><meta charset=x><body><p>Text</p>") == ["Text"]
    assert text("<svg><path d=''><p>One</p><iframe src=x><p>Two</p><template><template>no</template>no</template><p>Three") == ["One", "Two", "Three"]
    assert text("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be <object data=f>a figure</object> and <noscript>plain</noscript></p>") == ["Let x=1 be a figure and plain"]
    assert text("<p>a<svg><title>no</title><svg>no</svg>no</svg></p><canvas>no</canvas><!-- <svg> --><p>b") == ["a", "b"]


def test_labeller_on_held_out_layouts():
    model, wrong, total = html_text.trained(), 0, 0
    for h, marks in html_text.training_pages(120, seed=77):
        b = html_text.blocks(h)
        assert len(b) == len(marks)
        p = model.predict(*html_text.padded(html_text.vectors([b]), np.array([len(b)])))[0] >= 0.5
        wrong += int((p != np.array(marks)).sum())
        total += len(b)
    assert wrong <= 0.02 * total


def test_main_text_of_the_tables_pages(spark):
    got = queries.QUERIES["op5_html_main_text"](spark, "/root/testdata/sf0.001")
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in got.collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", inner)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_main_text_of_long_and_repeated_pages_with_clashing_names(spark):
    row = "<p>Words of the article number {}, long enough to be read &amp; kept whole.</p>"
    long = "<body><nav><a href=x>Home</a></nav><article>" + "".join(row.format(i) for i in range(3000)) + "</article><footer>&copy; me</footer>"
    rows = [(1, "u", long, "t", 5), (1, "u", long, "t", 5), (2, "u", "<article><p>Open <b>mark & no end", "t", None), (3, None, "\x00<<<>>&#x0;&bogus;</p></div>", None, None)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).orderBy("page_id").collect()
    assert [r.page_id for r in got] == [1, 1, 2, 3] and got[0] == got[1]
    blocks = got[0].text.split("\n\n")
    assert blocks == [f"Words of the article number {i}, long enough to be read & kept whole." for i in range(3000)]
    assert got[2].text == "Open mark & no end" and all(r.n_chars == len(r.text) for r in got)


def test_gradients():
    rng = np.random.default_rng(0)
    m = html_text.Labeller(rng, 5, 3)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x, mask = rng.normal(size=(2, 4, 5)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    y = (rng.random((2, 4)) > 0.5).astype(float)

    def loss():
        p = m.predict(x, mask)
        return -(np.log(np.where(y > 0, p, 1 - p)) * mask).sum() / mask.sum()

    g = m.gradients(x, mask, y)
    for k in m.w:
        i = tuple(rng.integers(s) for s in m.w[k].shape)
        old = m.w[k][i]
        m.w[k][i] = old + 1e-4
        up = loss()
        m.w[k][i] = old - 1e-4
        down = loss()
        m.w[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / 2e-4, abs=2e-3)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_text_operators import brute_groups, brute_repeats

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter(F.expr("crc32(cast(doc_id as string)) % 4 = 2"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        was, now = before.collect(), docs.collect()
        assert k == 4 or docs.columns == names
        if k == 0:
            kept = {r.doc_id for r in now}
            for good in (0, 1):
                held = [r.doc_id for r in labels.filter(f"quality = {good}").collect()]
                assert sum((i in kept) == bool(good) for i in held) >= 0.9 * len(held) > 0
            every = labels.collect()
            assert sum((r.doc_id in kept) == bool(r.quality) for r in every) >= 0.97 * len(every)
            assert len(now) >= 0.8 * len(was) and set(now) <= set(was)
        if k == 1:
            groups = brute_groups([(r.doc_id, r.text) for r in was], 80)
            assert sorted(r.doc_id for r in now) == sorted(int(i) for i, _, _, keep in groups if keep)
        if k == 2:
            want = {i: (gone, sha) for i, _, gone, sha in brute_repeats([(str(r.doc_id), r.text) for r in was])}
            old = {r.doc_id: r.text for r in was}
            assert len(now) == len(was)
            for r in now:
                gone, sha = want[str(r.doc_id)]
                assert hashlib.sha256(r.text.encode()).hexdigest() == sha if gone else r.text == old[r.doc_id]
        if k == 3:
            size = lambda rows: sum(len(r.text.split()) for r in rows)
            assert set(now) <= set(was) and abs(size(now) - size(was)) <= 0.05 * size(was)
        if k == 4:
            assert sorted(r.doc_id for r in now) == sorted(r.doc_id for r in was)
            text = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in was}
            assert all(r.decoded_sha256 == text[r.doc_id] for r in now)


def test_stages_take_nulls_ties_clashes_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    ddl = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, kept string, component_id long"
    rows = [(i, t, None, s, len(t) if t else None, None, 3, "k", None) for i, t, s in [(1, words("a", 60), "x"), (1, words("a", 60), "x"), (2, words("b", 60), None), (None, words("c", 60), "y"), (None, words("c", 60), "y"), (None, None, None), (3, "", "y"), (4, None, "z"), (5, words("d", 9000), "z")]]
    sf = "/root/testdata/sf0.001"
    for case, given in enumerate((rows, [])):
        docs = spark.createDataFrame(given, ddl)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf).write.parquet(f"{tmp_path}/{case}{k}")
            docs, names = spark.read.parquet(f"{tmp_path}/{case}{k}"), docs.columns
            assert k == 4 or docs.columns == names
        assert bool(docs.count()) == bool(given)


def test_near_dedup_stage_takes_four_fifths(spark):
    import corpus_pipeline
    from tests.llm.test_text_operators import brute_groups

    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(204)]
    rows = []
    for i, edits in enumerate([0, 2, 3, 4, 5, 6, 8]):
        words = list(base)
        for at in range(edits):
            words[20 + 22 * at] = f"e{i}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(f"x{v}" for v in rng.integers(10**6, size=40)))]
    kept = [sorted(int(i) for i, _, _, k in brute_groups(rows, p) if k) for p in (80, 85)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert kept[0] != kept[1] and sorted(r.doc_id for r in got.collect()) == kept[0]


def test_near_dedup_stage_judges_rows(spark):
    import corpus_pipeline

    text = lambda name, edit="": " ".join([f"{name}{i}" for i in range(100)] + [edit])
    rows = [(1, text("a")), (2, text("a", "x")), (2, text("b")), (3, text("c")), (3, text("c", "y")), (4, text("d")), (4, text("d")), (None, text("a")), (5, None), (5, None), (6, "")]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    left = sorted(((r.doc_id, r.text[:2] if r.text else r.text) for r in got), key=repr)
    assert left == sorted([(1, "a0"), (2, "b0"), (3, "c0"), (4, "d0"), (None, "a0"), (5, None), (6, "")], key=repr)
