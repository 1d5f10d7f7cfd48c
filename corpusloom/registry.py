"""Models by name, so that a run is told by a few strings which ones it uses.

A name is a registered word, or one and a slash and the maker's argument, as in hashing/128; of several registered
words that begin a name the longest counts. Makers of clients that this library doesn't have are added by their users.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from corpusloom.engine import Engine, Options
from corpusloom.models import FunctionLLM, HashingEmbedder, KeepAll, PatternExtractor, ReplyExtractor, ReplyFilter, StrictExtractor, first_passage
from corpusloom.sources.tables import working_folder


class Registry:
    def __init__(self, kind: str, **makers: Callable):
        self.kind, self.makers = kind, makers

    def add(self, word: str, maker: Callable) -> None:
        """maker takes what follows the word and a slash in a name ('' if nothing does), and what make is given besides."""
        if word in self.makers:
            raise ValueError(f"{self.kind} {word!r} is there already")
        self.makers[word] = maker

    def make(self, name: str, *given):
        fitting = [w for w in self.makers if name == w or name.startswith(w + "/")]
        if not fitting:
            raise ValueError(f"no {self.kind} {name!r}; there are {', '.join(sorted(self.makers))}")
        word = max(fitting, key=len)
        return self.makers[word](name[len(word) + 1 :], *given)


EMBEDDERS = Registry("embedder", hashing=lambda rest: HashingEmbedder(int(rest or 64)))
LLMS = Registry("language model", first_passage=lambda rest: FunctionLLM(first_passage))
#: Their makers are given the language model too.
EXTRACTORS = Registry("extractor", pattern=lambda rest, llm: PatternExtractor(tuple(rest.split("|"))) if rest else PatternExtractor(), reply=lambda rest, llm: ReplyExtractor(llm), strict=lambda rest, llm: StrictExtractor(llm))
FILTERS = Registry("fact filter", all=lambda rest, llm: KeepAll(), reply=lambda rest, llm: ReplyFilter(llm, int(rest) if rest else None))


def open_engine(spark: SparkSession, save_dir: str, llm: str = "first_passage", embedder: str = "hashing", extractor: str = "pattern", fact_filter: str = "all", options: Options = Options()) -> Engine:
    """An engine over the index of this pair of language model and embedder under save_dir, new or stored."""
    talker = LLMS.make(llm)
    return Engine(spark, working_folder(save_dir, llm, embedder), EMBEDDERS.make(embedder), EXTRACTORS.make(extractor, talker), talker, FILTERS.make(fact_filter, talker), options)
