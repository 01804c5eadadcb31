"""Language detection and language-name resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.fixed_values import CONTENT_LANGUAGE, DOCKERFILE_NAMES, EXTENSION_LANGUAGE, LANGUAGE_KEYS
from scanloom.functions.dialect import java_body
from scanloom.functions.reuse import built_once
from scanloom.functions.text import base_name, extension, literal_map

UNKNOWN = "unknown"


@built_once
def _extension_map() -> Column:
    return literal_map(EXTENSION_LANGUAGE)


@built_once
def _name_map() -> Column:
    names: dict[str, str] = {}
    for language, keys in LANGUAGE_KEYS.items():
        for name in [*keys, language]:
            names.setdefault(name, language)
    return literal_map(names)


def language_of_extension(ext: Column) -> Column:
    return F.try_element_at(_extension_map(), ext)


def language_of_content(content: Column) -> Column:
    return F.coalesce(*[
        F.when(content.rlike(f"(?{flags}d)" + java_body(regex)), F.lit(language))
        for regex, flags, language in CONTENT_LANGUAGE
    ])


def detect_language(path: Column, content: Column) -> Column:
    """File name first, then extension, and only for names that say nothing the text itself."""
    return F.coalesce(
        F.when(F.lower(base_name(path)).isin(DOCKERFILE_NAMES), F.lit("dockerfile")),
        language_of_extension(extension(path)),
        language_of_content(content),
        F.lit(UNKNOWN),
    )


def resolve_language(declared: Column, content: Column) -> Column:
    """Language of a text whose language is named by hand: alias or name, else as if it were a file suffix."""
    return F.coalesce(
        F.try_element_at(_name_map(), F.lower(declared)),
        detect_language(F.concat(F.lit("file."), declared), content),
    )
