from .arms import Settings, facts_to_graph
from .aws import aws_facts
from .azure import azure_facts, map_resources
from .cloudflare import cloudflare_facts
from .gcp import gcp_facts

__all__ = ["Settings", "facts_to_graph", "aws_facts", "azure_facts", "map_resources", "cloudflare_facts", "gcp_facts"]
