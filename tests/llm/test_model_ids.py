import public_tokenizers

from hostsieve.llm.tokens import Encoder


def test_new_words_of_a_byte_vocabulary_are_encoded_by_its_model():
    encode = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = [" hello", "Straße", " Ĉĝ", "1234567", " ½²", "'ll", "!?'", " ¡¿§", "x" * 300, "ÿ", " \x7e", "ɏɏ"]
    want = {p: encode.whole(p) for p in pieces}
    encode.tokenizer = None  # the library's search for places isn't needed
    assert encode.learn(pieces) == want
