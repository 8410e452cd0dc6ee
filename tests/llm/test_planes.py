"""Whole texts through the library against words that a task remembers."""

import itertools

from marketreach.llm import planes


def _library(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(planes.default_tokenizer())
    return [[*x.ids, planes.END] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def _ids(words, texts):
    import numpy as np

    return [np.frombuffer(x, words.width).tolist() for x in words.encode(texts)]


def test_signs_and_capitals_beside_latin_letters():
    pieces = [
        "Él", "é.", "É. ", "façade, ", "ÿ!", "ß; ", "×. ", "÷, ", "a.b. ", "x's. ", "'re, ", "1. ", "²: ", "é. ", "יִ. ",
        "K. ", "İ. ", "Σ. ΣΑΣ. ", "µ, ", "ª. ", "\xa0", "\x85", "\t", "\n", ". ", "?! ", "<|endoftext|>. ", "é́, ", "ŀ. ",
    ]
    texts = ["".join(p) for p in itertools.product(pieces, repeat=2)] + ["Où, DÉJÀ. a: b; c? d!", "Où.\tx,\ny.", ""]
    words = planes.Words(planes.default_tokenizer())
    assert _ids(words, texts) == _library(texts)


def test_a_word_is_learnt_once_whatever_sign_or_case():
    words = planes.Words(planes.default_tokenizer())
    texts = ["Déjà, déjà. DÉJÀ! déjà? déjà; déjà: déjà"]
    assert _ids(words, texts) == _library(texts)
    assert [w for w in words.held if w.startswith("d") or w.startswith("D")] == ["déjà"]
