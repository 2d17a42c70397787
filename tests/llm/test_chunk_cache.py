from vigil.llm.tokens import ChunkCache


class Counted(dict):
    looks = 0

    def __getitem__(self, key):
        Counted.looks += 1
        return dict.__getitem__(self, key)


def test_known_chunks_are_looked_up_once_and_unseen_ones_made_once():
    made = []

    def fill(chunks):
        made.append(list(chunks))
        return [c.upper() for c in chunks]

    cache = ChunkCache(fill, size=3)
    assert cache.lookup(["b", "a", "b"]) == ["B", "A", "B"] and made == [["b", "a"]]
    assert cache.lookup(["a", "c", "d", "a"]) == ["A", "C", "D", "A"] and made[1:] == [["c", "d"]]
    assert cache.lookup(["e", "a", "e", "d"]) == ["E", "A", "E", "D"] and made[2:] == [["e"]]     # a, d: the older generation's
    assert set(cache.new) == {"e", "a", "d"} and cache.lookup([]) == []
    cache.new = Counted(cache.new)
    assert cache.lookup(["a", "d", "a"]) == ["A", "D", "A"] and len(made) == 3 and Counted.looks == 0
