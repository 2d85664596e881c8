"""The jobs: operators put together from source to result."""
