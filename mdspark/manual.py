"""The manual, by topics."""

from __future__ import annotations

_TOPICS = {
    "overview": "mdspark answers queries over Markdown notes, or over any table whose rows stand for notes. Commands: index, search, query, backlinks, links, graph, pipeline, status, manual.",
    "index": "index(folder) reads all notes below a folder and writes notes, chunks, links and the postings of search terms as a new generation; readers see the old one until it is whole. embed() adds the vectors that are missing.",
    "search": "search(text, limit=8) ranks chunks by words (bm25), by vectors (rag), or by both fused (bm25+rag), with a snippet of each hit.",
    "query": "query(text, language) takes native, tasks, base, dataview, or another registered language. A limit of 100 rows applies unless another is given.",
    "backlinks": "backlinks(note) gives the notes that link to a note, by path.",
    "links": "links(note) gives the links of a note in their order, with the notes they lead to.",
    "graph": "graph(note, depth=2) follows resolved links in both directions and gives each note with its distance.",
    "pipeline": "pipeline(*stages) runs stages in the given order: filter:EXPR, bm25:TEXT, rag:TEXT, bm25+rag:TEXT. A ranker ranks all chunks and keeps those of its input; a filter keeps hits of matching notes and appends matching notes without a hit. context() packs the best chunk of each note into a budget of characters.",
    "status": "status() gives counts, unresolved links, vectors, and whether files or vectors are out of date.",
    "native": "PATH OPERATOR VALUE with and, or, not and parentheses. Operators: = != > >= < <= contains contains_all overlaps in starts_with ends_with matches exists missing. Paths are a.b[0]. Values are texts, numbers, true, false, null, [lists] and {objects}.",
    "tasks": "One instruction a line. Filters: done, not done, DATE-FIELD [before|after|on|in|on or before|...] DATE, DATE-FIELD date is invalid, has/no DATE-FIELD date, has/no tags|id|depends on|recurring|blocking|blocked, is [not] recurring|blocking|blocked, priority is [above|below|not] NAME, FIELD includes TEXT, FIELD regex matches /P/, status.type is TYPE, exclude sub-items, (A) AND|OR|XOR (B), NOT (A), filter by function. Then sort by FIELD [reverse], group by FIELD [reverse], sort/group by function, limit N, limit groups N. Dates: 2024-01-31, 2024-W05, 2024-01, 2024-Q1, 2024, today, last week, 20 June 2026, next friday, in 3 days.",
    "base": "A mapping with filters, formulas, summaries and views. Of the first view: filters, sort, limit, order, summaries, groupBy. The order of work is filters, formulas, sort, limit, summaries, groups, columns.",
    "dataview": "TABLE|LIST|CALENDAR|TASK columns, then FROM, WHERE, SORT, FLATTEN, GROUP BY and LIMIT in any order; they run as they are written, FROM first.",
    "dataviewjs": "A Python interface: pages(), page(), current(), date(), fileLink(); arrays with where, map, flatMap, sort, groupBy, distinct, limit; and list, table, taskList, paragraph, view to show rows.",
    "extensions": "register(name, language), Pipeline.stages and Pipeline.filters, task functions as Python callables, and Encoder(batch=...) take what is missing.",
    "examples": 'query(\'status = "open" and tags contains work\', "native"); query("not done\\ndue before tomorrow", "tasks"); query("TABLE file.name WHERE rating > 3 SORT rating DESC", "dataview"); pipeline("filter:area = garden", "bm25:tomato").',
}
_ALIASES = {"dql": "dataview", "dvjs": "dataviewjs", "api": "extensions"}


def topics() -> list[str]:
    return list(_TOPICS)


def render(topic: str = "all") -> str:
    """One topic, or all of them. An unknown topic raises ValueError with the known ones."""
    topic = _ALIASES.get(topic, topic)
    if topic == "all":
        return "\n\n".join(f"{name}\n{body}" for name, body in _TOPICS.items())
    if topic not in _TOPICS:
        raise ValueError(f"unknown topic {topic!r}; there are {', '.join(_TOPICS)}")
    return f"{topic}\n{_TOPICS[topic]}"
