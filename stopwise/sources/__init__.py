"""Batch sources: all-string documents, workbooks, and projected table scans."""

from stopwise.sinks.table import scan
from stopwise.sources.documents import read_document_sets, read_documents, read_json_documents
from stopwise.sources.quarantine import split_documents
from stopwise.sources.workbook import read_workbooks

__all__ = [
    "read_document_sets",
    "read_documents",
    "read_json_documents",
    "read_workbooks",
    "scan",
    "split_documents",
]
