"""Readers and writers: traces, text lines, XML configs, file catalogues."""

from runlens.sources.files import read_catalog, read_lines, read_xml_properties
from runlens.sources.traces import (
    append_traces, append_traces_stream, parse_trace_lines, read_traces, stream_traces, trace_file_name,
)

__all__ = [
    "append_traces", "append_traces_stream", "parse_trace_lines", "read_catalog",
    "read_lines", "read_traces", "read_xml_properties", "stream_traces", "trace_file_name",
]
