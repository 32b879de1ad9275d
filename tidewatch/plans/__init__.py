"""Complete queries: boards, ticker pages, search and the ingest job."""
