"""Models and page text against plain Python: scorers, training steps, pair loss, pages made from known articles."""

import html
import random

import numpy as np

from logweave.llm import langid, ngrams, pages, pieces, quality, toxicity
from logweave.llm.common import tokenizer_path

WORDS = ["house", "river", "été", "über", "walks", "bright", "table", "summer", "letter", "idiot", "x9", "don't"]


def sentences(seed, n, size=12):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, size))).encode() for _ in range(n)]


def bucket(gram, bits):
    return int(ngrams.gram_ids(np.frombuffer(gram, np.uint8), len(gram), bits)[0])


def mapped(text, digits):
    keep = lambda b: b >= 0x80 or chr(b).isalpha() or digits and chr(b).isdigit()
    return b" " + bytes(b if keep(b) else 32 for b in text.lower()) + b" "


def test_language_scores_by_brute_force():
    texts = [*sentences(1, 40), b"", b"123", b"a", "naïve  CAFÉ".encode()]
    rng = np.random.default_rng(0)
    model = langid.LanguageModel(["a", "b", "c"], rng.uniform(1, 3, 1 << langid.BITS), rng.normal(0, 2, (1 << langid.BITS, 3)), rng.normal(0, 1, 3), 1.7)
    best, p = langid._predict(texts, model.table(), model.bias, model.temperature)
    for k, t in enumerate(texts):
        m = mapped(t, False)
        grams = [bucket(m[i : i + n], langid.BITS) for n in langid.ORDERS for i in range(len(m) - n + 1)]
        z = sum(model.idf[g] / len(grams) * model.weights[g] for g in grams) + model.bias
        e = np.exp(z / model.temperature - (z / model.temperature).max())
        assert best[k] == e.argmax() and abs(p[k] - (e / e.sum()).max()) < 1e-4


def test_ftrl_steps_by_plain_python():
    texts, langs = sentences(2, 12), ["a", "b", "c"] * 4
    idf = np.random.default_rng(5).uniform(1, 3, 1 << langid.BITS)
    alpha, beta, l1, l2, seed = 0.5, 1e-3, 1e-3, 1e-2, 9
    model = langid.fit(texts, langs, idf, 2, alpha, beta, l1, l2, seed)
    rng = np.random.default_rng(seed)
    learn = rng.permutation(len(texts))
    z, n, bias = {}, {}, [0.0] * 3

    def weight(key):
        v = z.get(key, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - np.sign(v) * l1) / ((beta + n.get(key, 0.0) ** 0.5) / alpha + l2)

    for _ in range(2):
        for j in rng.permutation(learn):
            ids, tf = langid._vector(texts[j])
            w = {(i, c): weight((i, c)) for i in ids.tolist() for c in range(3)}
            s = [sum(f * idf[i] * w[i, c] for i, f in zip(ids.tolist(), tf, strict=True)) + bias[c] for c in range(3)]
            e = [np.exp(x - max(s)) for x in s]
            for c in range(3):
                p = e[c] / sum(e) - (langs[j] == "abc"[c])
                for i, f in zip(ids.tolist(), tf, strict=True):
                    g, old = f * idf[i] * p, n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * w[i, c]
                    n[i, c] = old + g * g
                bias[c] -= 0.01 * p
    want = np.zeros_like(model.weights)
    for i, c in z:
        want[i, c] = weight((i, c))
    assert model.languages == ["a", "b", "c"] and np.allclose(model.weights, want, atol=1e-9) and np.allclose(model.bias, bias)
    assert (want == 0).sum() > 0 and np.count_nonzero(want) > 10


def test_toxicity_scores_by_brute_force():
    texts = [*sentences(3, 30), b"", b"  ", b"go go go go stop", "x ÉÉ 99".encode()]
    rng = np.random.default_rng(1)
    model = toxicity.ToxicityModel(rng.normal(0, 1, (1 << toxicity.BITS, toxicity.WIDTH)).astype(np.float32), rng.normal(0, 1, (toxicity.WIDTH, 2)).astype(np.float32), np.array([0.2, -0.1]))
    got = model.scores(texts)
    for k, t in enumerate(texts):
        words = mapped(t, True).split()
        words = [w for i, w in enumerate(words) if i + 1 == len(words) or words[i + 1] != w]
        m = b" " + b" ".join(words) + b" "
        grams = [bucket(m[i : i + n], toxicity.BITS) for n in toxicity.ORDERS for i in range(len(m) - n + 1) if b" " not in m[i + 1 : i + n - 1] and m[i : i + n].strip()]
        mean = np.mean([model.embeddings[g] for g in grams], 0) if grams else np.zeros(toxicity.WIDTH)
        z = mean @ model.weights + model.bias
        assert abs(got[k] - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-4


def test_joint_training_steps_by_plain_python():
    texts, labels = sentences(4, 8), np.array([1, 0, 0, 1, 0, 0, 1, 0])
    rate, decay, seed = 0.3, 1e-6, 5
    model = toxicity.fit(texts, labels, 2, rate, decay, seed)
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 1, (toxicity.WIDTH, 2)).astype(np.float32).astype(float)
    share = labels.mean()
    b, e, e2 = np.log([1 - share, share]), {}, {}
    w2, b2 = np.full(w.shape, 1e-2), np.full(2, 1.0)
    for _ in range(2):
        for k in rng.permutation(len(texts)):
            ids, tf = toxicity._bag(texts[k])
            mean = 30 * sum(f * e.get(i, np.zeros(toxicity.WIDTH)) for i, f in zip(ids.tolist(), tf, strict=True))
            z = mean @ w + b
            p = np.exp(z - z.max())
            p = p / p.sum() - np.eye(2)[labels[k]]
            g = 30 * (w @ p)
            for i, f in zip(ids.tolist(), tf, strict=True):
                e2[i] = e2.get(i, 1e-10) + (f * np.sqrt(g @ g / toxicity.WIDTH)) ** 2
                old = e.get(i, np.zeros(toxicity.WIDTH))
                e[i] = old - rate * (f / np.sqrt(e2[i]) * g + decay * old)
            gw = np.outer(mean, p)
            w2 += gw**2
            w -= 0.1 * rate * gw / np.sqrt(w2)
            b2 += p**2
            b = b - 0.1 * rate * p / np.sqrt(b2)
    assert np.allclose(model.weights, 30 * w, rtol=1e-2, atol=1e-2) and np.allclose(model.bias, b, atol=1e-3)
    assert all(np.allclose(model.embeddings[i], v, rtol=1e-2, atol=1e-2) for i, v in e.items())


def test_pair_loss_is_at_its_minimum():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (300, quality.FEATURES))
    y = (x[:, 0] + 0.5 * x[:, 3] - x[:, 30] + rng.normal(0, 0.7, 300) > 0).astype(int)
    model = quality.fit(x, y, pairs=4000, steps=1500, decay=1e-2, seed=2)
    draw = np.random.default_rng(2)
    z = (x - model.centre) / model.scale
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    diff = z[draw.choice(good, 4000)] - z[draw.choice(bad, 4000)]

    def loss(w):
        return np.log1p(np.exp(-diff @ w)).mean() + 0.5e-2 * w @ w

    here = loss(model.weights)
    assert all(loss(model.weights + step * np.eye(quality.FEATURES)[j]) >= here - 1e-9 for j in range(quality.FEATURES) for step in (-1e-2, 1e-2))
    plain = [1 / (1 + np.exp(-(model.steepness * (sum(a * b for a, b in zip(v, model.weights, strict=True)) - model.cut) + np.log(0.7 / 0.3)))) for v in z[:20]]
    assert np.allclose(model.scores(x[:20]), plain)


def test_features_by_plain_python():
    text = "Aa aa BB 12!\nAa aa BB 12!\nlast |line é"
    raw = text.encode()
    f = quality.features(raw)
    kinds = {1: str.islower, 2: str.isupper, 3: str.isdigit}
    for k, test in kinds.items():
        assert abs(f[1 + k] ** 2 - sum(test(c) and c.isascii() for c in text) / len(raw)) < 1e-9
    words = text.split()
    assert f[12] == len(set(words)) / len(words) and f[15] == 2 / 3 and f[18] == sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
    m = mapped(raw, False)
    grams = [bucket(m[i : i + 3], quality.GRAMS) for i in range(len(m) - 2) if b" " not in m[i + 1 : i + 2]]
    want = np.bincount(grams, minlength=1 << quality.GRAMS) / len(grams)
    assert np.allclose(f[quality.SURFACE :] ** 2, want)


def made_page(rnd):
    """A page and its article's blocks: known text in random markup, between menus, boxes, forms and comments."""
    words = lambda n: " ".join(rnd.choice(["alpha", "beta & gamma", "déjà", "<tag>", "x", "“quoted”", "1 < 2"]) for _ in range(n))
    junk = ["<nav><ul><li><a href='/a'>menu one</a></ul></nav>", "<div class='ad-slot'>buy now</div>", "<aside>side</aside>", "<div class='cookie-notice'><p>we use cookies</p></div>", "<script>if(a<b){'</p>'}</script>", "<style>p{}</style>", "<form>name <input></form>", "<!-- <p>no</p> -->", "<div id='comments'><p>first!</p></div>", "<p hidden>gone</p>"]
    blocks, body = [], ""
    for _ in range(rnd.randrange(3, 9)):
        t = words(rnd.randrange(5, 30))
        blocks.append(" ".join(t.split()))
        inner = html.escape(t)
        if rnd.random() < 0.4:
            inner = inner.replace(" ", rnd.choice(["  ", "\n", "&nbsp;", " \t"]), 3)
        if rnd.random() < 0.4:
            inner = f"<b>{inner[:0]}</b>{inner}<i></i>"
        tag = rnd.choice(["p", "p", "h2", "blockquote", "li", "div"])
        extra = rnd.choice(["", " class='share-price'", " class=lead", " data-x='a>b'"])
        body += f"<{tag}{extra}>{inner}</{tag}>" + (rnd.choice(junk) if rnd.random() < 0.3 else "")
    depth = rnd.randrange(4)
    page = "<html><head><title>t</title></head><body>" + "".join(rnd.sample(junk, 3)) + "<div>" * depth + f"<article class='post-{rnd.randrange(99)}'>" + body + "</article>" + "</div>" * depth + "".join(rnd.sample(junk, 2)) + "<footer>foot</footer></body></html>"
    return page, blocks


def test_pages_made_from_known_articles():
    rnd = random.Random(12)
    for _ in range(300):
        page, blocks = made_page(rnd)
        assert pages.Page(page).text(None) == "\n\n".join(blocks)


def test_host_votes_by_brute_force(spark):
    rnd = random.Random(13)
    rows = [(k, f"http://h{k % 3}.example/{k}", *made_page(rnd)) for k in range(60)]
    frame = spark.createDataFrame([(k, u, p) for k, u, p, _ in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(frame).collect()}
    best = {}
    for _, u, p, _ in rows:
        for path, score in pages.Page(p).containers():
            best.setdefault(u.split("/")[2], {}).setdefault(path, []).append(score)
    won = {h: min(v.items(), key=lambda x: (-sum(x[1]), x[0]))[0] for h, v in best.items()}
    assert got == {k: pages.Page(p).text(won[u.split("/")[2]]) for k, u, p, _ in rows}
    assert {r.host: r.path for r in pages.winners(pages.with_host(frame)).collect()} == won


def test_pages_read_by_meaning_not_by_a_word():
    read = lambda h: pages.Page(h).text(None)
    assert read("<article><div class='share-price'>Shares rose 3 percent</div><p>b</p></article>") == "Shares rose 3 percent\n\nb"
    assert read("<p class='promo-story'>Real paragraph text here</p>") == "Real paragraph text here"
    assert read("<article><p>x</p><blockquote class='social'>said</blockquote><div class='social-links'>f t</div></article>") == "x\n\nsaid"
    assert read("<div class='widget'><p>all that there is</p></div>") == "all that there is"


def test_deep_and_long_pages_take_linear_memory():
    import tracemalloc

    tracemalloc.start()
    assert pages.Page("<div class='a b'>" * 20_000 + "text" + "</div>" * 20_000).text(None) == "text"
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert len(pages.Page("<article>" + "<p>some words here</p>" * 20_000 + "</article>").blocks) == 20_000


def test_segmentations_of_short_and_of_endless_chunks():
    model = pieces.pieces_for(tokenizer_path("piece_bpe_32k.model"))

    def paths(into, j):
        if j == 0:
            yield 0.0, ()
        for i, s, ids in into[j] if j else ():
            for a, p in paths(into, i):
                yield a + s, p + ids

    rnd = random.Random(6)
    texts = [c * k for c in "zaf. -é中" for k in range(1, 8)] + ["".join(rnd.choice("abz ") for _ in range(rnd.randrange(1, 8))) for _ in range(60)]
    for text in texts:
        full = "".join(model.chunks(text))
        scores = {np.array(ids, "<u4").tobytes(): s for s, ids in paths(model.edges(full), len(full))}
        for n in (1, 3):
            got = model.encode([text], n)[0]
            assert [s for s, _ in got] == sorted(scores.values(), reverse=True)[:n] == [scores[ids] for _, ids in got]
            assert len({ids for _, ids in got}) == len(got)
    for text in ("z" * 100_000, "ab" * 20_000, "中" * 5_000):
        got = model.encode([text], 3)[0]
        assert len({ids for _, ids in got}) == len(got) == (1 if "中" in text else 3) and all(model.decode(ids) == text for _, ids in got)
    assert model.held < 1_000_000
