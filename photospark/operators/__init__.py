"""DataFrame operators on light curves, candidates, views and catalogues."""
