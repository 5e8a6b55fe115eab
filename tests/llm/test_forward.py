"""The networks against plain versions that go byte by byte, and the toxicity machines against a reader of clauses."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import langid, quality, toxicity


def plain_quality(net, text):
    p = net.p
    cells = max(1, -(-len(text) // quality.CELL))
    padded = np.zeros((cells + 2) * quality.CELL + quality.TAPS, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    best = np.full((cells, quality.FILTERS), -np.inf)
    for c in range(cells):
        for i in range(c * quality.CELL, (c + 1) * quality.CELL, quality.STEP):
            window = np.concatenate([p["e"][b] for b in padded[i : i + quality.TAPS]])
            best[c] = np.maximum(best[c], window @ p["w"])
    hidden = []
    for a in range(0, max(1, cells - quality.CHUNK_CELLS + quality.CHUNK_STEP), quality.CHUNK_STEP):
        pooled = np.maximum(best[a : min(a + quality.CHUNK_CELLS, cells)].max(0) + p["b"], 0)
        hidden.append(np.maximum(pooled @ p["v"] + p["c"], 0))
    z = np.concatenate((np.mean(hidden, 0), np.max(hidden, 0))) @ p["u"] + p["d"][0]
    return 1 / (1 + np.exp(-z))


def test_quality_network_byte_by_byte():
    net = quality.ByteConvNet()
    rng = np.random.default_rng(1)
    net.p["b"] += rng.standard_normal(quality.FILTERS).astype(np.float32)
    texts = [b"", b"a", bytes(rng.integers(1, 256, 63, np.uint8)), bytes(rng.integers(1, 256, 64, np.uint8)), bytes(rng.integers(1, 256, 700, np.uint8))]
    assert np.allclose(net.score(texts), [plain_quality(net, t) for t in texts], atol=1e-4)


def plain_states(direction, data):
    u, h, out = direction.p["u"], np.zeros(langid.HIDDEN), []
    k = langid.HIDDEN
    for b in data:
        g, r = direction.p["table"][b], h @ u
        reset, update = (1 / (1 + np.exp(-(g[i * k : (i + 1) * k] + r[i * k : (i + 1) * k]))) for i in (0, 1))
        new = np.tanh(g[2 * k :] + reset * r[2 * k :])
        h = update * h + (1 - update) * new
        out.append(h)
    return np.array(out).reshape(len(data), k)


def test_language_network_byte_by_byte():
    net = langid.ByteLanguageNet(["a", "b", "c"])
    text = bytes(np.random.default_rng(2).integers(0, 256, 100, np.uint8))
    states = np.hstack((plain_states(net.forward, text), plain_states(net.back, text[::-1])[::-1]))
    z = states @ net.p["w"] + net.p["b"]
    logs = z - np.log(np.exp(z).sum(1, keepdims=True))
    pooled = np.exp(np.maximum(logs, -14).sum(0) / np.sqrt(len(text)))
    assert np.allclose(net.probabilities([text])[0], pooled / pooled.sum(), atol=1e-4)


SIGNS = [toxicity.BREAK, toxicity.LINE, toxicity.COLON, toxicity.COMMA, toxicity.QUOTE]


def plain_marks(symbols):
    """The settings of each event, by looking around it."""
    out = {}
    before, state = [], "out"
    for s in symbols:
        before.append(state in ("said", "quoted"))
        if state == "out":
            state = "said" if s == "speech" else "out"
        elif s == toxicity.LINE or state == "said" and s == toxicity.BREAK or state == "quoted" and s == toxicity.QUOTE:
            state = "out"
        elif state == "said" and s == toxicity.QUOTE:
            state = "quoted"
    after, state, left = [False] * len(symbols), "out", 0
    for i in range(len(symbols) - 1, -1, -1):
        s = symbols[i]
        word = s not in SIGNS and s != "speech"
        after[i] = state in ("comma", "clause", "quoted")
        if state == "out":
            state, left = ("verb", toxicity.SPEECH_REACH) if s == "speech" else ("out", 0)
        elif state == "verb":
            if word:
                left -= 1
                state = "verb" if left else "out"
            elif s == "speech":
                left = toxicity.SPEECH_REACH
            else:
                state = {toxicity.COMMA: "comma", toxicity.QUOTE: "quoted"}.get(s, "out")
        elif s == toxicity.LINE or s == toxicity.BREAK and state != "quoted":
            state = "out"
        elif s == toxicity.QUOTE:
            state = "quoted" if state == "comma" else "out"
        elif state == "comma" and (word or s == "speech"):
            state = "clause"
    ends = (toxicity.BREAK, toxicity.LINE, toxicity.COLON, toxicity.QUOTE)
    for i, s in enumerate(symbols):
        if s not in toxicity.BASES:
            continue
        marks = {"reported"} if before[i] or after[i] else set()
        for trigger, setting, reach in (("negation", "negated", toxicity.NEGATION_REACH), ("target", "aimed", toxicity.TARGET_REACH)):
            words = 0
            for j in range(i - 1, -1, -1):
                if symbols[j] in ends or words >= reach:
                    break
                if symbols[j] == trigger:
                    marks.add(setting)
                    break
                words += symbols[j] != toxicity.COMMA
        out[i] = "+".join((s, *(m for m in toxicity.SETTINGS if m in marks)))
    return out


@settings(max_examples=600)
@given(st.lists(st.sampled_from([*SIGNS, toxicity.OTHER, "target", "negation", "speech", "insult", "threat"]), max_size=25))
def test_machines_mark_as_a_plain_reader(symbols):
    got = toxicity.marked_clauses(symbols, MACHINES)
    assert {i: o for i, (o, _) in enumerate(got) if o in toxicity.EVENTS} == plain_marks(symbols)
    assert [o for o, _ in got if o not in toxicity.EVENTS] == [s for s in symbols if s not in toxicity.BASES]


MACHINES = toxicity.grammar()


def test_reported_sentences():
    model = toxicity.ToxicityGrammar({"idio": 5.0})
    for text in ('He said "you are an idiot"', "She said: you are an idiot.", "you are an idiot, he wrote", "\u201cYou are an idiot. Get out,\u201d the old man said."):
        marked = [o for o, _ in toxicity.marked_clauses(model.symbols(text.lower())[0], model.machines) if o in toxicity.EVENTS]
        assert marked == ["insult+reported+aimed"], text
    negated = toxicity.marked_clauses(model.symbols("you don\u2019t sound idiotic")[0], model.machines)
    assert [o for o, _ in negated if o in toxicity.EVENTS] == ["insult+negated+aimed"]
