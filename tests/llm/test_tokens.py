import numpy as np

from loomgraph.llm import queries as Q
from loomgraph.llm import tokens


def test_index_grows_and_finds():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 2**63, 50_000).astype(np.uint64))
    keys = np.concatenate([keys, (np.arange(1, 200, dtype=np.uint64) << np.uint64(20))])  # these all begin at one slot
    index = tokens.Index(16)
    order = rng.permutation(len(keys))
    for part in np.array_split(order, 40):
        index.add(keys[part])
    assert (index.find(keys[order]) == np.arange(len(keys))).all()
    assert (index.find(np.array([3, 5], dtype=np.uint64)) == -1).all()


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 300)
    e = tokens.WordEncoder(Q.tokenizer())
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{j}, Tok" for i in range(200)) for j in "abcdef"]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [e.encode([t])[0].tolist() for t in texts] == want
    assert e.index.used <= 900


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    e = tokens.WordEncoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert e.whole
    texts = ["Two  words, here.", None, ""]
    assert [x.tolist() for x in e.encode(texts, 9)] == [[*x.ids, 9] for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
