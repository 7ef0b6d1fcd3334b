"""The stateless part of a run on a stream of files."""
