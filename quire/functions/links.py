"""Canonical web addresses of corpus files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address under which library pages are published, and the
# folder name that marks the library root inside an absolute path.
STUDY_URL = "https://www.churchofjesuschrist.org/study/"
LIBRARY_MARKER = "gospel-library/"


def canonical_url(file_path: Column, base_url: str = STUDY_URL, marker: str = LIBRARY_MARKER) -> Column:
    """``<lang>/<page>.md`` → ``<base><page>?lang=<lang>``; '' for books and other paths."""
    at = F.instr(file_path, marker)
    after_marker = file_path.substr(at + len(marker), F.length(file_path))
    inside = F.when(at > 0, after_marker).otherwise(F.regexp_replace(file_path, "^/", ""))
    page = F.regexp_replace(inside, r"\.md\z", "")
    slash = F.instr(page, "/")
    lang = page.substr(F.lit(1), slash - 1)
    rest = page.substr(slash + 1, F.length(page))
    has_home = (
        ~file_path.contains("/books/")
        & ~file_path.startswith("books/")
        & (slash > 1)
        & (slash < F.length(page))
    )
    return F.when(
        F.coalesce(has_home, F.lit(False)),
        F.concat(F.lit(base_url), rest, F.lit("?lang="), lang),
    ).otherwise("")
