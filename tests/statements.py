"""Texts with dated statements, windows in words and model replies, with what is in them."""

STATEMENTS = {
    "a": "The Data Transfer Policy requires data localization for Personal Data effective 2022-01-01 until 2024-06-30. The Data Transfer Policy permits cross-border data transfers when the recipient implements Standard Contractual Clauses starting 2024-07-01. Cross-Border Data Regulation governs the transfer of Personal Data within the EU.",
    "b": "The Tax Reform Act imposes a 15 percent corporate minimum tax on Large Multinational Groups from 2023-01-01. The Tax Reform Act exempts small domestic companies until 2025-12-31. Corporate Finance Act amends the Tax Reform Act effective 2024-10-01.",
    "c": "Q3 2024 saw a change; effective January 2024 through March 2024. It ends on 12/31/2025 or 2026.",
    "d": "Nothing is dated here.",
}
WINDOWS = ["Q3 2024", "Q1-Q2 2025", "2024", "2024-03-01 to 2024-09-30", "January 2024 to March 2024", "as of Dec 31, 2023", "current quarter", "last 90 days", "what changed?", "H1 2024", "2024-07-15", "as of 2024-07-15", "2024-07", "year 3000", "previous quarter", "last month", "this year", "today", "last 2 months"]
REPLIES = [
    ("plain", '{"entities": [{"name": "EU", "type": "Jurisdiction"}, {"name": " "}], "relations": [{"subject": "A", "predicate": "amends", "object": "B", "validity": {"start": "2024-01-01", "end": "none"}}]}'),
    ("fenced", '```json\n{"relations": [{"subject": " A ", "predicate": "sets", "object": "C", "validity": {"start": "2024-02-30"}}, {"subject": "A", "predicate": "", "object": "D"}]}\n```'),
    ("salvaged", 'Here it is: {"relations": [{"subject": "E", "predicate": "bars", "object": "F", "validity": {"start": "2024-3-5 10:00:00", "end": "2024-04-01"}}]} Bye.'),
    ("broken", "no json {here"),
]

DATES = [("a", 0, "2022-01-01", "2022-01-01"), ("a", 1, "2024-06-30", "2024-06-30"), ("a", 2, "2024-07-01", "2024-07-01"), ("b", 0, "2023-01-01", "2023-01-01"), ("b", 1, "2024-10-01", "2024-10-01"), ("b", 2, "2025-12-31", "2025-12-31"), ("c", 0, "2024-01-01", "january 2024"), ("c", 1, "2024-03-01", "march 2024"), ("c", 2, "2024-07-01", "q3 2024"), ("c", 3, "2024-09-30", "q3 2024"), ("c", 4, "2025-12-31", "12/31/2025"), ("c", 5, "2026-01-01", "2026")]
CHUNK_WINDOWS = [("a", "2022-01-01", None), ("b", "2023-01-01", "2025-12-31"), ("c", "2024-01-01", "2026-01-01"), ("d", None, None)]
RELATIONS = [("a", "Data Transfer Policy", "requires", "data localization for Personal", "2022-01-01", "2024-06-30"), ("a", "Data Transfer Policy", "permits", "cross-border data transfers when", "2024-07-01", None), ("a", "Cross-Border Data Regulation", "governs", "transfer of Personal", None, None), ("b", "Tax Reform Act", "imposes", "15 percent corporate", "2023-01-01", None), ("b", "Corporate Finance Act", "amends", "Tax Reform Act", "2024-10-01", None), ("c", "Q3", "effective", "January 2024 through March", "2024-01-01", "2024-09-30")]
READ = [("Q3 2024", "2024-07-01", "2024-09-30"), ("Q1-Q2 2025", "2025-01-01", "2025-06-30"), ("2024", "2024-01-01", "2024-12-31"), ("2024-03-01 to 2024-09-30", "2024-03-01", "2024-09-30"), ("January 2024 to March 2024", "2024-01-01", "2024-03-31"), ("as of Dec 31, 2023", "2023-12-31", "2023-12-31"), ("current quarter", "2024-04-01", "2024-06-30"), ("last 90 days", "2024-02-15", "2024-05-15"), ("what changed?", None, None), ("H1 2024", "2024-01-01", "2024-06-30"), ("2024-07-15", "2024-07-15", "2024-07-16"), ("as of 2024-07-15", "2024-07-15", "2024-07-15"), ("2024-07", "2024-01-01", "2024-12-31"), ("year 3000", None, None), ("previous quarter", "2024-01-01", "2024-03-31"), ("last month", "2024-04-01", "2024-04-30"), ("this year", "2024-01-01", "2024-12-31"), ("today", "2024-05-15", "2024-05-15"), ("last 2 months", "2024-03-01", "2024-05-15")]
REPLIED = [("plain", "A", "amends", "B", "2024-01-01", None, "2024-01-01"), ("fenced", "A", "sets", "C", None, None, None), ("salvaged", "E", "bars", "F", "2024-03-05", "2024-04-01", "2024-03-05")]
