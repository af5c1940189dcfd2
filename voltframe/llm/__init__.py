"""Operations of a training-data pipeline over a table of documents; nothing outside this subpackage imports it."""
