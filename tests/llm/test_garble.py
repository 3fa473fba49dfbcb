import numpy as np
import pytest

from sedimenta.llm import garble as g

SAMPLES = {
    "de": "Für ältere Geräte brauchen wir größere Puffer. Die Prüfung läuft über viele Stunden, weil die Reihenfolge gehört. ",
    "fr": "Le deuxième correctif mérite un meilleur nom, dès que la file est pleine à café. L’accès a été séparé. ",
    "ru": "Второй патч теряет память при сбое, потому что порядок неверен. Очередь работает только случайно. ",
    "zh": "错误路径会泄漏内存，而且没有人注意到。缓冲区过于复杂，正如报告所示。",
    "en": "The caller makes no sense here and the naming is far too clever. It costs a cache miss per call. ",
}
CODECS = {"de": ["cp1252", "mac_roman"], "fr": ["cp1252", "mac_roman"], "ru": ["koi8-r", "cp1251", "cp866"], "zh": ["gbk"], "en": []}


def damaged(text, meant, wrong):
    raw = g.encode(text, meant)
    return None if raw is None else g.decode(raw, wrong)


def rows():
    out = [(i, SAMPLES[k] * 3, k) for i, k in enumerate(list(SAMPLES) * 400)]
    return out


@pytest.fixture(scope="module")
def found(spark):
    data, cases = [(i, "subject", t, None) for i, t, _ in rows()], {}
    n = 5000
    for lang, text in SAMPLES.items():
        pairs = [("utf-8", w) for w in ("cp1252", "latin-1", "cp1251", "cp437", "mac_roman", "cp1250") if lang != "en"]
        pairs += [(m, w) for m in CODECS[lang] for w in ("cp1252", "latin-1", "cp1251", "koi8-r", "mac_roman") if m != w]
        for meant, wrong in pairs:
            if (meant, wrong) in {("cp1252", "latin-1")}:
                continue
            bad = damaged(text, meant, wrong)
            if bad and bad != text:
                cases[n] = (text, bad, meant, wrong)
                data.append((n, "subject", "ok " + bad, None))
                n += 1
    twice = damaged(damaged(SAMPLES["fr"], "utf-8", "cp1252"), "utf-8", "cp1252")
    cases[n] = (SAMPLES["fr"], twice, "utf-8", "twice")
    data += [(n, "", "ok " + twice, None), (9001, "", "gr��ere Puffer", None), (9002, "", None, None), (9003, "", "", ""), (9004, "", "þÿThe caller", None), (9005, "", "Ängstlig ÅÄÖ × ½ °C 🙂", None)]
    df = spark.createDataFrame([(i, t, b) for i, _, t, b in data], "delivery_id long, subject string, body string").selectExpr("*", "1 as slot", "'x' as field")
    return {r.delivery_id: r for r in g.restore(df.repartition(5), "delivery_id", ["subject", "body"]).collect()}, cases


def test_every_damaged_value_is_found(found):
    got, cases = found
    assert [(cases[i][2:]) for i in cases if i not in got] == []
    assert not [i for i in got if i < 5000]


def test_most_are_restored_exactly(found):
    got, cases = found
    good = sum(got[i].restored == "ok " + cases[i][0] for i in cases)
    assert good / len(cases) >= 0.75


def test_special_values(found):
    got, _ = found
    assert got[9001].lost and got[9004].restored == "The caller" and not {9002, 9003, 9005} & set(got)


def test_empty(spark):
    assert g.restore(spark.createDataFrame([], "delivery_id long, subject string"), "delivery_id", ["subject"]).count() == 0


def test_maximal_segments_against_brute_force():
    rng = np.random.default_rng(0)

    def brute(x, lo, hi):
        best = max(((sum(x[i:j]), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        return [*brute(x, lo, best[3]), (best[3], best[4]), *brute(x, best[4], hi)]

    for _ in range(300):
        x = [float(v) for v in rng.integers(-5, 6, rng.integers(0, 14))]
        got = g.maximal_segments(x)
        # ties may be cut differently; the sums are those of the definition
        assert sorted(sum(x[a:b]) for a, b in got) == sorted(sum(x[a:b]) for a, b in brute(x, 0, len(x)))
    long = g.maximal_segments([1.0, -3.0] * 200_000)
    assert len(long) == 200_000


def test_stretches_between_lost_characters():
    texts = [SAMPLES[k] * 3 for k in SAMPLES] * 400
    n = np.zeros((1 << g.PAIR_BITS) + (1 << g.CHAR_BITS), np.int64)
    cp = g.code_points(g.BOUND.join(texts) + g.BOUND)
    np.add.at(n, g.pair_slots(cp[:-1], cp[1:]), 1)
    np.add.at(n, g.char_slots(cp).astype(np.int64) + (1 << g.PAIR_BITS), 1)
    used = np.flatnonzero(n)
    model = g.Model(used, n[used])
    bad = SAMPLES["zh"].encode().decode("gbk", "replace")
    assert g.LOST in bad
    new, runs, lost = g.repaired(model, bad, model.improbability(g.code_points(g.BOUND + bad + g.BOUND)))
    assert runs and lost and "径会泄漏内存" in new and "没有人注意到。缓冲区过于复杂" in new
    # what stays between two lost characters is neither dropped nor made up
    assert g.decode_between("错误".encode()[1:-1], "utf-8", True, True) is None
    assert g.decode_between("错误路".encode()[1:-1], "utf-8", True, True) == ("误", 2, 2)
    assert g.decode_between("错误路".encode()[1:-1], "utf-8", False, True) is None
