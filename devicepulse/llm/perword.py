"""Apply a function to the words of texts, once per distinct word while it is remembered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

# Words are what spaces and line ends separate; longer ones are not remembered.
LONGEST = 64
# So many words, and as many of an older generation, take some 200 MB.
REMEMBERED = 500_000
# Characters of text whose words are looked up together.
STEP = 1 << 20


class PerWord:
    """``function`` gets a list of distinct words and returns a value, not None, for each."""

    def __init__(self, function: Callable[[list[str]], list], remembered: int = REMEMBERED):
        self.function, self.remembered = function, remembered
        self.known: dict = {}
        self.older: dict = {}

    def each(self, texts: list[str]) -> Iterator[list]:
        """The values of the words of each text, in order."""
        batch, size = [], 0
        for text in texts:
            batch.append(text.replace("\n", " ").split(" "))
            size += len(text)
            if size >= STEP:
                yield from self._several(batch)
                batch, size = [], 0
        yield from self._several(batch)

    def _several(self, batch: list[list[str]]) -> Iterator[list]:
        if len(self.known) > self.remembered:
            # Words that are met again move on, the others are forgotten in time.
            self.known, self.older = {}, self.known
        values = self.known
        # Most words are remembered, so all are looked up once; gaps are filled afterwards.
        found = [list(map(values.get, words)) for words in batch]
        gaps = [[i for i, v in enumerate(f) if v is None] if None in f else [] for f in found]
        missing = {words[i] for words, places in zip(batch, gaps) for i in places}
        again = missing & self.older.keys()
        values.update((w, self.older[w]) for w in again)
        new = list(missing - again)
        values.update(zip(new, self.function(new)))
        for words, places, known in zip(batch, gaps, found):
            for i in places:
                known[i] = values[words[i]]
        yield from found
        for word in new:
            if len(word) > LONGEST:
                del values[word]
