"""Tables, records, archives, ROI trees and injected services; sinks and exports."""

from latticebits.operators.graph import Graph, build_graph
from latticebits.sources.services import ExportConfig, connect, doctor, export, export_graph
from latticebits.sources.tables import validate_export

__all__ = ["ExportConfig", "Graph", "build_graph", "connect", "doctor", "export", "export_graph", "validate_export"]
