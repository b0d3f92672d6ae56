"""Reports, pipelines and the catalogue of registered queries."""
