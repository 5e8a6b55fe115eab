from lodestone.llm import toxicity


def test_documents_that_begin_alike_all_count():
    header = "The same header of over forty characters on each page: "
    bad = [header + f"you are a blorknaz number{i} x{i}y" for i in range(40)]
    good = [header + f"a fine day for item{i} z{i}w" for i in range(40)]
    stems = toxicity.learn_stems(bad + good, [1] * 40 + [0] * 40)
    assert any("blorknaz".startswith(s) for s in stems)
    # Copies of one text are one document.
    assert not toxicity.learn_stems([bad[0]] * 40 + good, [1] * 40 + [0] * 40)
