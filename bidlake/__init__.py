"""bidlake: procurement analytics and data preparation as DataFrame operators."""
