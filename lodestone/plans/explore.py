"""What a reader does with an index: search it, look into one note, see its graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import embed, graph, highlight, media, results, search
from lodestone.plans.session import BoundedCache, more_to_show, page_limits, query_cache, result_cache, searchable
from lodestone.plans.settings import Settings

#: Hits and phrases of a search in one note.
NOTE_HITS, NOTE_PHRASES = 250, 5
#: Notes whose texts are kept.
NOTE_TEXTS = 8


class NotReady(Exception):
    """The index has no passages."""


class Explorer:
    """Searches a snapshot of an index (the store's schema). The token sets of paths are
    kept with it, as a cached side table. :meth:`refresh` takes a newer snapshot."""

    def __init__(self, index: DataFrame, model: embed.Embedder, settings: Settings | None = None, notes: DataFrame | None = None):
        self.model, self.settings, self.notes = model, settings or Settings(), notes
        self.vectors, self.found, self.lexical = query_cache(), result_cache(), None
        self.texts = BoundedCache(NOTE_TEXTS, refresh=True)
        self.refresh(index)

    def refresh(self, index: DataFrame) -> None:
        """Search ``index`` from now on: what was found before is forgotten."""
        for kept in (self.found, self.vectors, self.texts):
            kept.clear()
        if self.lexical is not None:
            self.lexical.unpersist()
        self.lexical = search.with_lexical(index.select("file").distinct()).cache()
        self.passages = index.withColumn("passage_id", F.xxhash64("file", "chunk_no"))

    def is_alive(self) -> bool:
        """Whether a search of anything finds something."""
        try:
            return not self.hits("test", 1, 0.0, 1.0).isEmpty()
        except NotReady:
            return False

    def query_vector(self, query: str) -> list[float]:
        key = " ".join(query.split()).lower()
        return self.vectors.get(key, lambda: [float(x) for x in embed.embed_all(self.model, [query], "query")[0]])

    def hits(self, query: str, top_k: int, min_score: float, window: float, boost: float = 0.0, file: str | None = None, max_phrases: int | None = None) -> DataFrame:
        """The best passages with their texts and highlights; kept for the next time."""
        key = (query.strip().lower(), top_k, min_score, window, boost, file, max_phrases)
        return self.found.get(key, lambda: self._hits(query, top_k, min_score, window, boost, file, max_phrases))

    def _hits(self, query: str, top_k: int, min_score: float, window: float, boost: float, file: str | None, max_phrases: int | None) -> DataFrame:
        if self.passages.isEmpty():
            raise NotReady
        t, spark = self.settings.tuning, self.passages.sparkSession
        vector = self.query_vector(query)
        narrow = self.passages.select("passage_id", "file", "embedding").join(self.lexical, "file")
        found = search.search(narrow, vector, query, top_k, min_score, window, boost, file)
        found = spark.createDataFrame(found.collect(), found.schema)  # at most a thousand rows
        wide = search.fetch(found, self.passages)
        own = wide.select("passage_id", F.posexplode("candidates").alias("pos", "c")).select("passage_id", "pos", "c.*")
        marked = highlight.highlight_hits(
            found,
            own,
            query,
            F.array(*map(F.lit, vector)),
            t.highlight_result_min_score,
            max_phrases=max_phrases or t.highlight_max_phrases,
            single_min=t.highlight_single_word_min_score,
            phrase_min=t.highlight_phrase_min_score,
        )
        if not t.semantic_highlights:
            marked = marked.limit(0)
        return wide.drop("candidates").join(marked, "passage_id", "left").cache()

    def cards(self, query: str, visible: int = 0) -> tuple[DataFrame | None, bool]:
        """(a page of note cards in rank order, whether there are more)."""
        if not searchable(query):
            return None, False
        s, t = self.settings, self.settings.tuning
        asked, raw = page_limits(visible, t.top_k, one_note=False)
        found = self.hits(query, raw, t.min_score, t.score_window, t.folder_path_boost if s.folder_path_boost_enabled else 0.0)
        cards = results.group_by_note(found, query, raw)
        more = more_to_show(cards.count(), asked, found.count(), raw)
        return cards.limit(asked), more

    def passages_of(self, query: str, file: str, visible: int = 0) -> DataFrame | None:
        """The best passages of one note."""
        if not searchable(query):
            return None
        asked, raw = page_limits(visible, self.settings.tuning.top_k, one_note=True)
        found = self.hits(query, raw, self.settings.tuning.min_score, self.settings.tuning.score_window, file=file)
        return results.by_passage(found, query, asked)

    def note_text(self, file: str) -> str:
        """What a note of ``notes`` (file, content) says; kept for the next time."""

        def read() -> str:
            found = self.notes.filter(F.col("file") == file).select("content").first() if self.notes is not None else None
            return found.content or "" if found else ""

        return self.texts.get(file, read)

    def find_in_note(self, query: str, file: str, text: str | None = None) -> list:
        """(from, to, text, line, ch) of a query, its terms and what highlights it in a note's
        text: the one given, as an editor has it, or else the note's own."""
        if not searchable(query):
            return []
        text = self.note_text(file) if text is None else text
        found = self.hits(query, NOTE_HITS, 0.0, 1.0, file=file, max_phrases=NOTE_PHRASES)
        pool = [r.phrase for r in results.phrase_pool(found).collect()]
        spark = self.passages.sparkSession
        note = spark.createDataFrame([(text, query, pool)], "text string, query string, pool array<string>")
        return media.in_note_matches(note, F.col("query"), T.query_terms(F.col("query")), F.col("pool")).first().matches

    def graph(self, links: DataFrame | None = None, query: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes with place, degree, score and style; edges with style)."""
        s = self.settings
        nodes = graph.centroids(self.passages)
        edges = graph.capped(graph.knn_edges(nodes, s.graph_k), s.graph_max_edges)
        hard = links if links is not None and s.show_wikilinks else self.passages.sparkSession.createDataFrame([], "source string, target string, count int")
        merged = graph.merge_links(edges, hard)
        ends = graph.endpoints(merged)
        scores = search.scores_per_note(self.passages, F.array(*map(F.lit, self.query_vector(query)))) if query else ends.select(F.col("id").alias("file"), F.lit(0.0).alias("score"))
        placed = graph.layout(ends).join(graph.degrees(merged), "id")
        return graph.node_style(graph.overlay(placed, scores), bool(query)), graph.edge_style(merged)
