"""What Python workers hold on to between tasks, and the cost of checks a piece."""

import gc
import random
import time
import weakref

import pyarrow as pa

from quillon.llm import contracts, jaccard_join, packing, tokens

TEXTS = ["one two three four five six", None, "", "a b c, d. <|endoftext|> e"]


class Table:
    """Stands for a DataFrame; gives the function that its workers would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, read, _):
        return read


def task(read, *columns):
    return list(read(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f"c{k}" for k in range(len(columns))])])))


def test_a_worker_drops_its_encoder_when_another_operator_starts(spark):
    path, ids = contracts.vocabulary("byte_bpe_50k.json"), list(range(len(TEXTS)))
    pack = packing.token_pieces(Table(), path, 1024, 2)
    first = task(pack, ids, TEXTS)
    held = weakref.ref(tokens.encoder(path))
    assert task(pack, ids, TEXTS) == first and tokens.encoder(path) is held()  # from task to task of one operator it stays
    sets = task(jaccard_join.first_pass(Table(), 3, 90), ids, ids, TEXTS)
    gc.collect()
    assert held() is None
    assert sets[0].column(3).to_pylist() == [4, 0, 0, 4]
    assert task(pack, ids, TEXTS) == first


class Counting:
    """A pattern that counts its searches."""

    def __init__(self, pattern):
        self.pattern, self.n = pattern, 0

    def search(self, text):
        self.n += 1
        return self.pattern.search(text)


def test_new_words_are_checked_together(spark):
    words = [f"wörd{k}x" for k in range(9000)]
    texts = [" ".join(words), "a | b", "x\x85y", "<|EndOfText|>", "<|endoftext|>", "one <|endoftext|> two", "< | >", " ", "\x1c", "q. r, <s>."]
    for file in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = tokens.PieceEncoder(contracts.vocabulary(file))
        assert [x.tobytes() for x in enc.encode(texts)] == enc.whole(texts)
        enc = tokens.PieceEncoder(contracts.vocabulary(file))
        enc.odd = Counting(enc.odd)
        enc.encode(texts[:1])
        assert enc.odd.n < 3000  # not one for each of the 9000 words


def test_texts_nobody_asks_for_are_not_shuffled(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.randbytes(30).hex() for _ in range(300)) for _ in range(400)]
    texts += [texts[7] + " end", texts[7], texts[8] + " end"]
    rows = [(k if k % 3 else None, t) for k, t in enumerate(texts)] + [(9, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.5)
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    got = {(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert written() - before < sum(map(len, texts)) / 3
    assert {(400, 7), (401, 7), (7, 7), (8, 8)} <= got and (9, 7) in got and len([x for x in got if x[1] == 7]) == 4
