"""The tool interface: arguments, results as text or JSON, JSON-RPC over stdio or HTTP, and the command line."""
