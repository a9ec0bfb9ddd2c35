"""Readers and writers."""

from .io import (  # noqa: F401
    append_missing, delete_keys, load_dataset, markdown, read_arrays, read_config, read_csv, read_images, read_sentences, table, write_arrays,
    write_by_suffix, write_csv, write_json_report, write_partitioned,
)
