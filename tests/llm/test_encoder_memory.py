from quillstream.llm import encoder as enc


def test_an_encoder_forgets_when_a_task_ends(monkeypatch):
    # before, idle processes kept all that their encoders had met
    monkeypatch.setattr(enc, "KEPT", 3)
    path = enc.tokenizer_file("byte_bpe_50k.json")
    e = enc.encoder(path)
    text = "one two three four five six seven eight, nine ten"

    def run(batches):
        for b in batches:
            yield e.encode(b)

    assert list(enc.shrinking(run)([text])) == [e.whole(text)]
    assert max(map(len, (e.words, e.heads, e.pretokens))) <= 3
    assert e.encode(text) == e.whole(text)
