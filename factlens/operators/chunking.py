"""Pages to overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.functions.text import clean, token_estimate

SIZE, OVERLAP = 800, 120
_PIECE = "struct<text:string,page:int,fresh:boolean,size:int>"
_CHUNK = "struct<text:string,page_start:int,page_end:int,char_start:long,char_end:long,continued:boolean>"
_STATE = f"struct<buffer:array<{_PIECE}>,held:long,chars:long,start:long,at:long,fresh:boolean,chunks:array<{_CHUNK}>>"


def paragraphs(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """doc, page, position, text, fresh: the cleaned paragraphs between blank lines, blank ones left out. fresh: a page's
    first paragraph, unless it ends in a dash."""
    parts = F.filter(F.split(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"\n\n"), lambda p: clean(p) != "")
    rows = pages.select(doc, page, F.posexplode(parts).alias("position", "raw"))
    continued = F.col("raw").rlike(r"[-–]\s*$")
    return rows.select(doc, page, "position", clean("raw").alias("text"), ((F.col("position") == 0) & ~continued).alias("fresh"))


def hard_split(text: Column, size: int) -> Column:
    """A long paragraph cut at sentence ends into pieces of up to `size` tokens; a longer sentence stays whole."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: s != "")

    def pack(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(last, F.lit(" "), s)
        fits = (F.size(acc) > 0) & (token_estimate(last) + token_estimate(s) <= size)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(parts, F.array().cast("array<string>"), pack)


def _flushed(state: Column, continued: Column, overlap: int) -> Column:
    """state after its buffer has become a chunk and its longest tail within the overlap has stayed."""
    buffer = state["buffer"]
    pages = F.transform(buffer, lambda p: p["page"])
    chunk = F.struct(F.array_join(F.transform(buffer, lambda p: p["text"]), " ").alias("text"), F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"), state["start"].alias("char_start"), (state["start"] + state["chars"]).alias("char_end"), continued.alias("continued"))
    sums = lambda k: F.aggregate(F.slice(buffer, -k, k), F.lit(0).cast("long"), lambda s, p: s + p["size"])
    tails = F.filter(F.sequence(F.lit(1), F.size(buffer)), lambda k: sums(k) <= overlap)
    kept = F.coalesce(F.array_max(tails), F.lit(0))
    tail = F.when(kept > 0, F.slice(buffer, -F.greatest(kept, F.lit(1)), F.greatest(kept, F.lit(1)))).otherwise(F.array().cast(f"array<{_PIECE}>"))
    return F.struct(
        tail.alias("buffer"),
        F.aggregate(tail, F.lit(0).cast("long"), lambda s, p: s + p["size"]).alias("held"),
        F.when(kept > 0, state["chars"]).otherwise(F.lit(0).cast("long")).alias("chars"),
        F.when(kept > 0, state["start"]).otherwise(state["at"]).alias("start"),
        state["at"].alias("at"),
        state["fresh"].alias("fresh"),
        F.concat(state["chunks"], F.array(chunk.cast(_CHUNK))).alias("chunks"),
    ).cast(_STATE)


def chunk_documents(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """doc, chunk_id, index, text, page_start, page_end, char_start, char_end, continued_from_page.

    Paragraphs are packed in order; a chunk is closed before the piece that would take it over `size`, and its tail of up
    to `overlap` tokens opens the next one. A paragraph over `size` is cut by sentences if nothing is held then. The
    fold runs inside one row per document, whose pages are bounded by the document.
    """
    pieces = paragraphs(pages, doc, page, text).withColumn("size", token_estimate("text"))
    listed = pieces.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(page, "position", "text", "fresh", "size"))).alias("rows"))

    def add(state: Column, piece: Column) -> Column:
        full = (state["held"] + piece["size"] > size) & (F.size(state["buffer"]) > 0)
        let = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
        length = (F.length(piece["text"]) + 1).cast("long")

        def put(s: Column) -> Column:
            fresh = F.size(s["buffer"]) == 0
            return F.struct(F.concat(s["buffer"], F.array(piece.cast(_PIECE))).alias("buffer"), (s["held"] + piece["size"]).alias("held"), (s["chars"] + length).alias("chars"), F.when(fresh, s["at"]).otherwise(s["start"]).alias("start"), (s["at"] + length).alias("at"), piece["fresh"].alias("fresh"), s["chunks"].alias("chunks")).cast(_STATE)

        return let(F.when(full, _flushed(state, ~piece["fresh"], overlap)).otherwise(state), put)

    def paragraph(state: Column, row: Column) -> Column:
        one = lambda t: F.struct(t.alias("text"), row[page].cast("int").alias("page"), row["fresh"].alias("fresh"), token_estimate(t).alias("size")).cast(_PIECE)
        cut = (F.size(state["buffer"]) == 0) & (row["size"] > size)
        parts = F.when(cut, F.transform(hard_split(row["text"], size), one)).otherwise(F.array(one(row["text"])))
        return F.aggregate(parts, state, add)

    zero = F.lit(0).cast("long")
    start = F.struct(F.array().cast(f"array<{_PIECE}>").alias("buffer"), zero.alias("held"), zero.alias("chars"), zero.alias("start"), zero.alias("at"), F.lit(False).alias("fresh"), F.array().cast(f"array<{_CHUNK}>").alias("chunks")).cast(_STATE)
    folded = listed.select(doc, F.aggregate("rows", start, paragraph).alias("state"))
    last = F.when(F.size("state.buffer") > 0, _flushed(F.col("state"), F.lit(False), overlap)["chunks"]).otherwise(F.col("state.chunks"))
    out = folded.select(doc, F.posexplode(last).alias("index", "c"))
    return out.select(doc, F.format_string("%s:c%05d", F.col(doc).cast("string"), "index").alias("chunk_id"), "index", "c.text", "c.page_start", "c.page_end", "c.char_start", "c.char_end", F.col("c.continued").alias("continued_from_page"))
