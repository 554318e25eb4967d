"""crawlquarry: crawl-policy analytics and text-corpus preparation on PySpark."""

__version__ = "0.1.0"
