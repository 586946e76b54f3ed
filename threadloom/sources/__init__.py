"""Sources and sinks (S-series): landing files in, engine tables out."""
